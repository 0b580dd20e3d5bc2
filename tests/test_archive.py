import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures.pack import tar_header, tar_member
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlake.operators.walk import record_batches, record_words
from ledgerlake.schemas import ACCOUNT_VERSIONS, pick
from ledgerlake.sources.archive import ArchiveError, is_accounts_member, member_size, padded, read_members
from tests.conftest import account_member, key, record, stream, tar_zst


def members(data, **options):
    return list(read_members(stream(data), "a.tar.zst", **options))


@pytest.mark.parametrize(
    "field, size",
    [
        (b"00000000644\0", 420),
        (b"644 ", 420),
        (b"  644", 0),
        (b"", 0),
        (b"0000000018\0", 16),
        (b"\x80" + bytes(9) + b"\x01\x00", 256),
        (b"\xff" + bytes(10) + b"\x07", 7),
    ],
)
def test_member_size(field, size):
    assert member_size(field) == size


def test_member_size_that_is_no_number():
    with pytest.raises(ArchiveError):
        member_size(b"12x4\0")


@pytest.mark.parametrize(
    "name, typeflag, kept",
    [
        ("x/accounts/1.2", b"0", True),
        ("accounts/1.2", b"\0", True),
        ("accounts/", b"5", False),
        ("account/1.2", b"0", False),
        ("accounts/1.2", b"x", False),
        ("n" * 92 + "accounts", b"0", False),
        ("n" * 91 + "accounts/", b"0", True),
    ],
)
def test_account_members(name, typeflag, kept):
    assert is_accounts_member(tar_header(name, 0, typeflag)) is kept


def test_prefix_field_and_long_names_are_not_read():
    header = bytearray(tar_header("1.2", 0))
    header[345:354] = b"accounts/"
    assert not is_accounts_member(header)
    pax = tar_member("PaxHeaders/1.2", b"20 path=accounts/1.2\n", b"x")
    found = members(tar_zst(pax, tar_member("1.2", record())))
    assert [c.member.is_accounts for c in found] == [False, False]


def test_listing_and_bodies():
    data = tar_zst(tar_member("version", b"1.2.0"), account_member("accounts/1.1", record(), record()))
    version, accounts = members(data)
    assert (version.member.path, version.member.size, version.content) == ("version", 5, None)
    assert (accounts.member.entry_no, accounts.member.size, accounts.content) == (1, 272, record() * 2)
    assert [c.member.path for c in members(data, accounts_only=True)] == ["accounts/1.1"]
    assert [c.content for c in members(data, with_content=False)] == [None, None]


def test_archive_ends():
    one = account_member("accounts/1.1", record())
    assert len(members(tar_zst(one, ending=b""))) == 1
    assert len(members(tar_zst(one, ending=one[:100]))) == 1
    assert len(members(tar_zst(one, ending=bytes(512) + one))) == 1
    with pytest.raises(ArchiveError, match="ends inside member accounts/1.1"):
        members(tar_zst(one[:600], ending=b""))
    with pytest.raises(ArchiveError):
        members(tar_zst(one[:-1], ending=b""))
    with pytest.raises(ArchiveError):
        members(tar_zst(tar_member("other", b"x" * 600)[:700], ending=b""))


def test_name_that_starts_with_nul_ends_the_archive_unless_asked_otherwise():
    odd = bytearray(account_member("accounts/2.2", record()))
    odd[0] = 0
    data = tar_zst(account_member("accounts/1.1", record()), bytes(odd))
    assert len(members(data)) == 1
    assert len(members(data, end_on_empty_name=True)) == 2


def test_member_across_two_frames():
    plain = account_member("accounts/1.1", *[record()] * 9) + bytes(1024)
    codec = zstandard.ZstdCompressor()
    data = codec.compress(plain[:700]) + codec.compress(plain[700:])
    (chunk,) = members(data)
    assert chunk.content == record() * 9


PLACE = to_arrow_schema(pick(ACCOUNT_VERSIONS, "rec_offset", "pubkey"))


def fields(chunks):
    return [
        tuple(row.values())
        for c in chunks
        for batch in record_batches(c.content, PLACE, archive="", path="", base_offset=c.base_offset)
        for row in batch.to_pylist()
    ]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=30), st.integers(1, 5000), st.integers(0, 135))
def test_chunks_hold_whole_records(lengths, chunk_bytes, tail):
    body = b"".join(record(pubkey=key(str(i)), data=bytes(n)) for i, n in enumerate(lengths)) + b"\1" * tail
    data = tar_zst(tar_member("accounts/1.1", body))
    whole, cut = members(data), members(data, chunk_bytes=chunk_bytes)
    assert b"".join(bytes(c.content) for c in cut) == body
    assert [c.chunk_no for c in cut] == list(range(len(cut)))
    assert fields(cut) == fields(whole)
    assert len(fields(cut)) == len(lengths)


def test_overrun_in_a_member_larger_than_a_chunk():
    good = [record(data=bytes(500))] * 4
    body = b"".join(good) + record(data_len=10**9) + b"".join(good)
    data = tar_zst(tar_member("accounts/1.1", body), tar_member("accounts/2.2", record()))
    chunks = members(data, chunk_bytes=1024)
    first = [c for c in chunks if c.member.path == "accounts/1.1"]
    assert sum(len(record_words(c.content)[0]) for c in first) == 4
    assert record_words(first[-1].content)[1] == 0 and first[-1].base_offset == 4 * 640
    assert chunks[-1].member.path == "accounts/2.2" and chunks[-1].content == record()


def test_window_beyond_the_default_limit():
    options = zstandard.ZstdCompressionParameters.from_level(1, window_log=28)
    codec = zstandard.ZstdCompressor(compression_params=options).compressobj()
    data = codec.compress(account_member("accounts/1.1", record()) + bytes(1024)) + codec.flush()
    assert zstandard.get_frame_parameters(data).window_size == 2**28
    assert [c.content for c in members(data)] == [record()]


def test_padding():
    assert [padded(n) for n in (0, 1, 512, 513)] == [0, 512, 512, 1024]


def test_globs_keep_to_the_kind_and_brackets_are_names(tmp_path):
    from ledgerlake.sources.files import list_files
    from ledgerlake.sources.snapshot import ARCHIVE_PATTERNS

    for name in ("snapshot-1.tar.zst", "snapshot-[1].tar.zst", "incremental-snapshot-2.tar.zst", "ledger-3.tar.zst"):
        (tmp_path / name).write_bytes(b"x")

    def names(tail, kind):
        return [uri.rsplit("/", 1)[1] for uri, _ in list_files(f"{tmp_path}{tail}", ARCHIVE_PATTERNS[kind])]

    assert names("/*.tar.zst", "incremental") == names("", "incremental") == ["incremental-snapshot-2.tar.zst"]
    assert names("/*.tar.zst", "full") == names("", "full") == ["snapshot-1.tar.zst", "snapshot-[1].tar.zst"]
    assert len(names("", "all")) == 4 and names("/snapshot-[1].tar.zst", "all") == ["snapshot-[1].tar.zst"]
    with pytest.raises(FileNotFoundError):
        names("/none*.tar.zst", "all")
