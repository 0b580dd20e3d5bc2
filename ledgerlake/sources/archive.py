"""Walk one zstd-compressed tar archive and cut its account members into chunks.

A chunk always ends where a record ends, so chunks can be unfolded apart from
each other. Only a member larger than the chunk size is walked here.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard

from ledgerlake.operators.walk import complete_records
from ledgerlake.schemas import RECORD_HEADER_BYTES
from ledgerlake.sources.files import locate

# Fixed values of the formats read.
BLOCK = 512
MAX_WINDOW = 2**31
ACCOUNTS_MARK = b"accounts/"
MAX_CELL = 2**31 - 1

DEFAULT_CHUNK = 32 << 20
SKIP_BYTES = 1 << 20


class ArchiveError(ValueError):
    """An archive that cannot be read to its end."""


@dataclass(frozen=True)
class Member:
    entry_no: int
    path: str
    typeflag: str
    size: int
    is_accounts: bool


@dataclass(frozen=True)
class Chunk:
    member: Member
    chunk_no: int
    base_offset: int
    content: bytes | bytearray | None


def padded(size: int) -> int:
    """Bytes a member of this size takes in the archive."""
    return -(-size // BLOCK) * BLOCK


def member_size(field: bytes) -> int:
    """The size field: base-256 when its high bit is set, octal text up to a NUL or space otherwise.

    Digits 8 and 9 count as 8 and 9; anything else is an error.
    """
    if field and field[0] >= 0x80:
        return int.from_bytes(field[-8:] if len(field) > 8 else field[1:], "big")
    text = field.replace(b" ", b"\0").partition(b"\0")[0].decode("latin-1")
    if text.strip("0123456789"):
        raise ArchiveError(f"member size is not a number: {text!r}")
    return sum(int(digit) << (3 * place) for place, digit in enumerate(reversed(text)))


def is_accounts_member(header: bytes) -> bool:
    """A regular file with the accounts mark anywhere in its 100 name bytes."""
    return header[156:157] in (b"0", b"\0") and ACCOUNTS_MARK in header[:100]


class _Stream:
    """Exact-length reads over a decompressing stream."""

    def __init__(self, raw, name: str):
        self.raw, self.name = raw, name
        self.scratch = memoryview(bytearray(SKIP_BYTES))

    def fill(self, view: memoryview) -> int:
        got = 0
        while got < len(view):
            n = self.raw.readinto(view[got:])
            if not n:
                break
            got += n
        return got

    def take_into(self, view: memoryview, member: str) -> None:
        if self.fill(view) < len(view):
            raise ArchiveError(f"{self.name}: archive ends inside member {member}")

    def skip(self, count: int, member: str) -> None:
        while count:
            step = min(count, SKIP_BYTES)
            self.take_into(self.scratch[:step], member)
            count -= step


def _body_chunks(stream: _Stream, member: Member, chunk_bytes: int) -> Iterator[Chunk]:
    left, base, number, want = member.size, 0, 0, chunk_bytes
    carry = b""
    while True:
        take = min(want, left)
        if len(carry) + take > MAX_CELL:
            raise ArchiveError(
                f"{stream.name}: record at {member.path}+{base} is larger than a binary cell"
            )
        body = bytearray(len(carry) + take)
        body[: len(carry)] = carry
        stream.take_into(memoryview(body)[len(carry):], member.path)
        left -= take
        if not left:
            yield Chunk(member, number, base, body)
            return
        cut, needed = complete_records(body)
        if cut:
            yield Chunk(member, number, base, body[:cut])
            carry, base, number, want = body[cut:], base + cut, number + 1, chunk_bytes
        elif base + needed > member.size:
            # The record runs past its member. The header alone is enough for
            # the record walk to report it; nothing after it can be read.
            yield Chunk(member, number, base, body[:RECORD_HEADER_BYTES])
            stream.skip(left, member.path)
            return
        else:
            carry, want = body, max(padded(needed) - len(body), BLOCK)


def read_members(
    raw,
    name: str,
    *,
    accounts_only: bool = False,
    with_content: bool = True,
    chunk_bytes: int = DEFAULT_CHUNK,
    end_on_empty_name: bool = False,
) -> Iterator[Chunk]:
    """Chunks of every member of one archive, in archive order.

    Members that hold no accounts, or all when `with_content` is off, give one
    chunk without content. The archive ends at a header that starts with NUL
    (or, with `end_on_empty_name`, at one whose whole name is NUL) or where the
    stream ends before a full header.
    """
    chunk_bytes = max(padded(chunk_bytes), BLOCK)
    codec = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW)
    stream = _Stream(codec.stream_reader(raw, read_size=4 << 20, read_across_frames=True), name)
    header = bytearray(BLOCK)
    entry_no = 0
    while stream.fill(memoryview(header)) == BLOCK:
        if not (any(header[:100]) if end_on_empty_name else header[0]):
            return
        member = Member(
            entry_no,
            bytes(header[:100]).partition(b"\0")[0].decode("utf-8", "replace"),
            chr(header[156]),
            member_size(bytes(header[124:136])),
            is_accounts_member(header),
        )
        if member.is_accounts and with_content:
            yield from _body_chunks(stream, member, chunk_bytes)
            stream.skip(padded(member.size) - member.size, member.path)
        else:
            if member.is_accounts or not accounts_only:
                yield Chunk(member, 0, 0, None)
            stream.skip(padded(member.size), member.path)
        entry_no += 1


def read_archive(uri: str, **options) -> Iterator[Chunk]:
    """`read_members` over a file on any supported file system."""
    fs, path = locate(uri)
    with fs.open_input_stream(path, compression=None, buffer_size=4 << 20) as raw:
        yield from read_members(raw, posixpath.basename(path), **options)
