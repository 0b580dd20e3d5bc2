"""ANSI SQL over the given tables that must give the same rows as each query.

It works from the meaning of the synthetic ledger (FIXTURES.md) and never sees
an encoded byte.
"""

from __future__ import annotations

TOKEN = "06ddf6e1d765a193d9cbe146ceeb79ac1cb485ed5f5b37913a8cf5857eff00a9"
MAX_U64 = "18446744073709551615"

_N = """n AS (
  SELECT greatest(4, least(ceil(c / 75000.0), greatest(4096, ceil(c / 8000000.0))))::BIGINT AS archives
  FROM (SELECT count(*) AS c FROM lineitem))"""

_RECORDS = f"""records AS (
  SELECT 'wallet:' || c_custkey AS name, c_custkey AS spread, c_custkey AS write_version,
         CASE WHEN c_custkey % 10 = 0 THEN 0 WHEN c_custkey % 100 = 3 THEN {MAX_U64}
              ELSE c_custkey * 1000 + c_nationkey END::HUGEINT AS lamports,
         CASE WHEN c_custkey % 2 = 0 THEN '{MAX_U64}' ELSE '361' END AS rent_epoch,
         repeat('0', 64) AS owner, 0 AS data_len, 0 AS executable
  FROM customer
  UNION ALL
  SELECT 'mint:' || p_partkey, p_partkey, p_partkey,
         CASE WHEN p_partkey % 20 = 0 THEN 0 ELSE 1461600 END, '{MAX_U64}', '{TOKEN}', 82, 0
  FROM part
  UNION ALL
  SELECT 'token:' || l_orderkey || ':' || l_linenumber,
         l_orderkey + l_partkey + l_suppkey * 3 + l_linenumber + CAST(l_quantity AS BIGINT), l_partkey,
         CASE WHEN l_linenumber = 7 THEN 0 ELSE 2039280 END, '{MAX_U64}', '{TOKEN}', 165, 0
  FROM lineitem
  UNION ALL
  SELECT 'program:' || s_suppkey, s_suppkey, s_suppkey, 1000000 + s_suppkey, '0', sha256('loader'), 36,
         s_suppkey % 3
  FROM supplier
  UNION ALL
  SELECT 'decoy_len:' || n_nationkey, n_nationkey, n_nationkey, 5000 + n_nationkey, '0', '{TOKEN}', 170, 0
  FROM nation
  UNION ALL
  SELECT 'decoy_owner:' || r_regionkey, r_regionkey, r_regionkey, 6000 + r_regionkey, '0', sha256('other'), 82, 0
  FROM region)"""

_PLACED = """placed AS (
  SELECT records.*, spread % (2 * archives) AS member, spread % (2 * archives) // 2 AS archive_no,
         (136 + data_len + 7) // 8 * 8 AS bytes
  FROM records, n)"""

_VERSIONS = """versions AS (
  SELECT sha256(name) AS pubkey, sha256('hash:' || name) AS hash, name, write_version, lamports, rent_epoch,
         owner, data_len, executable
  FROM records
  UNION ALL
  SELECT repeat('0', 64), repeat('0', 64), '', 0, 0, '0', repeat('0', 64), 0, 0
  FROM (SELECT unnest(range(6 * archives)) FROM n))"""

_MEMBERS = """members AS (
  SELECT archive_no, entry_no, path, typeflag, size, is_accounts FROM (
    SELECT archive_no, 2 + member % 2 AS entry_no, 'accounts/' || (1000 + member) || '.' || member AS path,
           '0' AS typeflag, sum(bytes)::BIGINT + 448 AS size, true AS is_accounts
    FROM placed GROUP BY archive_no, member
    UNION ALL
    SELECT a, e, p, t, s, false
    FROM (SELECT unnest(range(archives)) AS a FROM n),
         (VALUES (0, 'version', '0', 5), (1, 'accounts/', '5', 0), (4, 'snapshots/1000/1000', '0', 700),
                 (5, 'snapshots/status_cache', '0', 10)) AS v(e, p, t, s)))"""

_ARCHIVE = """CASE WHEN archive_no >= archives * 3 // 4 THEN 'incremental-snapshot-' ELSE 'snapshot-' END
  || archive_no || '.tar.zst'"""

_MINTS = """mints AS (
  SELECT p_partkey, sha256('mint:' || p_partkey) AS pubkey,
         CASE WHEN p_partkey % 30 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS authority_tag,
         CASE WHEN p_partkey % 30 <> 0 AND p_partkey % 3 <> 1 THEN sha256('authority:' || p_size) END
           AS mint_authority,
         CASE WHEN p_size > 25 THEN sha256('freeze:' || p_size) END AS freeze_authority,
         CASE WHEN p_partkey = 9 THEN 18446744073709551615 WHEN p_partkey % 50 = 1 THEN 1
              ELSE p_partkey * 1000 + p_size END::HUGEINT AS supply,
         CASE WHEN p_partkey % 50 = 1 THEN 0 ELSE p_size % 10 END AS decimals,
         p_partkey % 4 <> 0 AS is_initialized
  FROM part)"""

_TOKENS = f"""tokens AS (
  SELECT l_partkey, sha256('token:' || l_orderkey || ':' || l_linenumber) AS pubkey,
         sha256('mint:' || CASE WHEN l_partkey % 30 = 6 THEN l_partkey + 3 ELSE l_partkey END) AS mint, sha256('wallet:' || l_suppkey) AS owner,
         CASE WHEN l_partkey % 300 = 9 THEN {MAX_U64}
              ELSE CAST(l_quantity AS BIGINT) * 1000 + l_linenumber END::HUGEINT AS amount,
         CASE WHEN l_returnflag = 'R' THEN sha256('wallet:' || (l_suppkey + 1)) END AS delegate,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS state,
         CASE WHEN l_partkey % 100 = 0 THEN 2039280 END AS is_native,
         CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS delegated_amount,
         CASE WHEN l_returnflag = 'A' THEN sha256('close:' || l_suppkey) END AS close_authority
  FROM lineitem)"""

_VERIFIED = "verified AS (SELECT * FROM tokens WHERE l_partkey % 3 = 0)"
_VERIFIED_MINTS = "verified_mints AS (SELECT * FROM mints WHERE p_partkey % 3 = 0)"

_PROBES = """probes AS (
  SELECT CASE WHEN user_id % 10 <> 0 THEN 'n' || user_id || ':8899' END AS rpc, event_id % 2 AS path_no, event_id,
         CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 200 ELSE 302 END AS status,
         CASE WHEN event_id % 3 = 0 AND user_id % 10 <> 0
                THEN 'http://n' || user_id || ':8899/snap-' || event_id || '.tar.zst'
              WHEN event_id % 3 = 1 THEN 'http://h' || user_id || '/s' || event_id || '.tar.zst'
              WHEN event_id % 12 IN (2, 5) AND user_id % 10 <> 0
                THEN 'http://n' || user_id || ':8899/snapshot.tar.' || CASE event_id % 2 WHEN 0 THEN 'zst' ELSE 'bz2' END
                  || CASE event_id % 12 WHEN 5 THEN '#f' ELSE '' END END AS url,
         CASE WHEN event_id % 5 <> 0 THEN event_id * 1000 END AS size,
         event_id * 1000 AS bytes, value AS secs, event_id * 32000 AS bytes2, value * 30 + event_id % 7 AS secs2
  FROM events)"""

_CANDIDATES = """candidates AS (
  SELECT * FROM probes WHERE rpc IS NOT NULL AND status BETWEEN 300 AND 399 AND url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rpc ORDER BY path_no, event_id) = 1)"""

_SHORTLIST = """shortlist AS (
  SELECT *, CASE WHEN bytes > 0 AND secs > 0 THEN bytes / secs ELSE 0 END AS speed
  FROM candidates WHERE bytes > 0 AND secs > 0 ORDER BY speed DESC, url LIMIT 5)"""

_PARTS = {
    "n": _N,
    "records": _RECORDS,
    "placed": _PLACED,
    "versions": _VERSIONS,
    "members": _MEMBERS,
    "mints": _MINTS,
    "tokens": _TOKENS,
    "verified": _VERIFIED,
    "verified_mints": _VERIFIED_MINTS,
    "probes": _PROBES,
    "candidates": _CANDIDATES,
    "shortlist": _SHORTLIST,
}


def _over(parts: str, select: str) -> str:
    return "WITH " + ",\n".join(_PARTS[p] for p in parts.split()) + "\n" + select


def _accounts(condition: str) -> str:
    return _over(
        "n records versions",
        "SELECT pubkey, lamports::VARCHAR AS lamports, owner, data_len::VARCHAR AS data_len,"
        f" executable = 1 AS executable, rent_epoch FROM versions WHERE {condition}",
    )


_MINT_COLUMNS = (
    "pubkey, mint_authority, freeze_authority, supply::VARCHAR AS supply,"
    " decimals::INTEGER AS decimals, is_initialized"
)
_TOKEN_COLUMNS = (
    "pubkey, mint, owner, amount::VARCHAR AS amount, delegate, state::INTEGER AS state,"
    " is_native::VARCHAR AS is_native, delegated_amount::VARCHAR AS delegated_amount, close_authority"
)
_HELD_ORDER = "PARTITION BY mint ORDER BY amount DESC, pubkey"
_ALIVE = "lamports <> 0"
_ENTRIES = "n records placed members"


def _little_endian(hex_text: str) -> str:
    return " || ".join(f"substr({hex_text}, {at}, 2)" for at in range(15, 0, -2))


ORACLES: dict[str, str] = {
    "archive_entries": _over(
        _ENTRIES,
        f"""SELECT {_ARCHIVE} AS archive, entry_no::BIGINT AS entry_no, path, typeflag, size::BIGINT AS size,
                   is_accounts, 1::BIGINT AS chunks, CASE WHEN is_accounts THEN size END::BIGINT AS content_bytes
            FROM members, n""",
    ),
    "archive_manifest": _over(
        _ENTRIES,
        f"""SELECT {_ARCHIVE} AS archive, count(*) AS entries, count(*) FILTER (is_accounts) AS account_files,
                   sum(CASE WHEN is_accounts THEN size ELSE 0 END)::BIGINT AS account_bytes,
                   sum(CASE WHEN is_accounts THEN (size + 511) // 512 * 512 ELSE 0 END)::BIGINT AS padded_bytes
            FROM members, n GROUP BY 1""",
    ),
    "accounts_entries_only": _over(
        _ENTRIES,
        f"SELECT {_ARCHIVE} AS archive, path, size::BIGINT AS size FROM members, n WHERE is_accounts",
    ),
    "incremental_scan": _over(
        "n records placed",
        f"""SELECT sha256(name) AS pubkey, lamports::VARCHAR AS lamports, owner, data_len::VARCHAR AS data_len,
                   executable = 1 AS executable, rent_epoch
            FROM placed, n WHERE archive_no >= n.archives * 3 // 4 AND {_ALIVE}""",
    ),
    "known_mints": "SELECT sha256('mint:' || p_partkey) AS pubkey FROM part WHERE p_partkey % 3 = 0",
    "view_counts": _over(
        "n records versions mints tokens verified verified_mints",
        f"""SELECT 'accounts' AS name, count(*) AS rows FROM versions WHERE {_ALIVE}
            UNION ALL SELECT 'mints', count(*) FROM verified_mints
            UNION ALL SELECT 'token_accounts', count(*) FROM verified""",
    ),
    "accounts_all_versions": _over(
        "n records versions",
        """SELECT write_version::VARCHAR AS write_version, data_len::VARCHAR AS data_len, pubkey,
                  lamports::VARCHAR AS lamports, rent_epoch, owner, executable::INTEGER AS executable, hash
           FROM versions""",
    ),
    "describe_accounts": _over(
        "n records versions",
        """SELECT write_version::VARCHAR AS write_version, data_len::VARCHAR AS data_len, pubkey,
                  lamports::VARCHAR AS lamports, rent_epoch, owner, executable::INTEGER AS executable, hash
           FROM versions""",
    ),
    "bench_counts": _over(
        _ENTRIES,
        """SELECT count(*) AS entries, count(*) FILTER (is_accounts) AS account_files,
                  sum(CASE WHEN is_accounts THEN size ELSE 0 END)::BIGINT AS account_bytes,
                  (SELECT count(*) FROM records) + 3 * count(*) FILTER (is_accounts) AS accounts
           FROM members""",
    ),
    "accounts": _accounts(_ALIVE),
    "accounts_include_dead": _accounts("true"),
    "filter_owner": _accounts(f"{_ALIVE} AND owner = sha256('loader')"),
    "filter_hash": _accounts(f"{_ALIVE} AND hash = sha256('hash:mint:4')"),
    "filter_pubkey": _accounts(f"{_ALIVE} AND pubkey = sha256('wallet:3')"),
    "filter_conjunction": _accounts(f"{_ALIVE} AND owner = '{TOKEN}' AND pubkey = sha256('mint:9')"),
    "decoder_match": _over(
        "n records versions",
        f"""SELECT pubkey, data_len::VARCHAR AS data_len, owner = '{TOKEN}' AND data_len = 82 AS is_mint,
                   owner = '{TOKEN}' AND data_len = 165 AS is_token_account
            FROM versions""",
    ),
    "decoder_dispatch": _over(
        "n records versions",
        f"""SELECT CASE WHEN owner = '{TOKEN}' AND data_len = 82 THEN 'mints'
                        WHEN owner = '{TOKEN}' AND data_len = 165 THEN 'token_accounts'
                        WHEN owner = sha256('loader') AND data_len = 36 THEN 'programs' ELSE 'other' END AS chosen,
                   count(*) AS versions, sum(lamports)::VARCHAR AS lamports
            FROM versions GROUP BY 1""",
    ),
    "zero_keys": _over(
        "n records versions",
        """SELECT pubkey = repeat('0', 64) AS zero_pubkey, owner = repeat('0', 64) AS zero_owner,
                  count(*) AS versions
           FROM versions GROUP BY 1, 2""",
    ),
    "mints_all": _over("mints", f"SELECT {_MINT_COLUMNS} FROM mints"),
    "token_accounts_all": _over("tokens", f"SELECT {_TOKEN_COLUMNS} FROM tokens"),
    "mints_verified": _over("mints verified_mints", f"SELECT {_MINT_COLUMNS} FROM verified_mints"),
    "token_accounts_verified": _over("tokens verified", f"SELECT {_TOKEN_COLUMNS} FROM verified"),
    "nft_mints": _over("mints", f"SELECT {_MINT_COLUMNS} FROM mints WHERE supply = 1 AND decimals = 0"),
    "option_fields": _over(
        "mints tokens",
        """SELECT pubkey, 'mint_authority' AS field, authority_tag::INTEGER AS tag, mint_authority AS value FROM mints
           UNION ALL
           SELECT pubkey, 'freeze_authority', (freeze_authority IS NOT NULL)::INTEGER, freeze_authority FROM mints
           UNION ALL
           SELECT pubkey, 'delegate', (delegate IS NOT NULL)::INTEGER, delegate FROM tokens
           UNION ALL
           SELECT pubkey, 'close_authority', (close_authority IS NOT NULL)::INTEGER, close_authority FROM tokens
           UNION ALL
           SELECT pubkey, 'is_native', (is_native IS NOT NULL)::INTEGER, is_native::VARCHAR FROM tokens""",
    ),
    "custom_decoder": """SELECT sha256('program:' || s_suppkey) AS pubkey, '2' AS kind,
                                sha256('programdata:' || s_suppkey) AS programdata FROM supplier""",
    "base58_round_trip": _over(
        "mints", "SELECT pubkey, pubkey AS decoded, mint_authority, freeze_authority FROM mints"
    ),
    "key_bytes": _over(
        "n records versions",
        f"""SELECT pubkey, 32::INTEGER AS width, ('0x' || substr(pubkey, 1, 2))::INTEGER AS first_byte,
                   owner = '{TOKEN}' AS of_token_program
            FROM versions""",
    ),
    "u64_columns": _over(
        "mints",
        f"""SELECT pubkey, supply::VARCHAR AS supply,
                   CASE WHEN supply > 9223372036854775807 THEN supply - 18446744073709551616 ELSE supply END::BIGINT
                     AS supply_bits,
                   decimals::INTEGER AS decimals,
                   {_little_endian("lower(lpad(to_hex(supply), 16, '0'))")} AS supply_bytes
            FROM mints""",
    ),
    "run_metrics": _over(
        "n records placed",
        f"SELECT count(*) AS rows_parsed, sum(bytes)::BIGINT AS record_bytes FROM placed WHERE {_ALIVE}",
    ),
    "sink_round_trip": _over(
        "n records versions mints tokens verified verified_mints",
        f"""SELECT 'accounts' AS name, count(*) AS rows, sum(lamports)::HUGEINT::VARCHAR AS total,
                   max(owner) AS last_key
            FROM versions WHERE {_ALIVE}
            UNION ALL
            SELECT 'mints', count(*), sum(supply)::HUGEINT::VARCHAR, max(mint_authority) FROM verified_mints
            UNION ALL
            SELECT 'token_accounts', count(*), sum(amount)::HUGEINT::VARCHAR, max(close_authority) FROM verified""",
    ),
    "stream_accounts": _accounts(_ALIVE),
    "source_candidates": _over(
        "probes candidates",
        "SELECT rpc, path_no::INTEGER AS path_no, url, size::BIGINT AS size FROM candidates",
    ),
    "rank_sources_rough": _over(
        "probes candidates shortlist", "SELECT url, round(speed, 6) AS speed FROM shortlist"
    ),
    "rank_sources_final": _over(
        "probes candidates shortlist",
        """SELECT rank::INTEGER AS rank, url, round(mbps, 6) AS mbps, rank = 1 AS best FROM (
             SELECT url, mbps, row_number() OVER (ORDER BY mbps DESC, url) AS rank FROM (
               SELECT url, bytes2 / 1048576 / secs2 AS mbps FROM shortlist WHERE bytes2 > 0 AND secs2 > 0))""",
    ),
    "sql_top_holders": _over(
        "tokens verified",
        """SELECT owner, amount::VARCHAR AS amount, accounts FROM (
             SELECT owner, sum(amount) AS amount, count(*) AS accounts
             FROM verified GROUP BY owner ORDER BY amount DESC, owner LIMIT 20)""",
    ),
    "sql_supply_vs_held": _over(
        "mints tokens verified verified_mints",
        """SELECT m.pubkey AS mint, m.supply::VARCHAR AS supply, sum(t.amount)::VARCHAR AS held
           FROM verified t JOIN verified_mints m ON t.mint = m.pubkey GROUP BY m.pubkey, m.supply""",
    ),
    "sql_left_unheld_mints": _over(
        "mints tokens verified verified_mints",
        """SELECT pubkey AS mint FROM verified_mints m
           WHERE NOT EXISTS (SELECT 1 FROM verified t WHERE t.mint = m.pubkey)""",
    ),
    "sql_wallet_balances": _over(
        "n records versions mints tokens verified verified_mints",
        f"""SELECT a.pubkey AS wallet, a.lamports::VARCHAR AS lamports, sum(t.amount)::VARCHAR AS amount,
                   count(*) AS token_accounts, count(DISTINCT t.mint) AS mints, max(m.decimals)::INTEGER AS max_decimals
            FROM (SELECT * FROM versions WHERE {_ALIVE}) a
            JOIN verified t ON t.owner = a.pubkey JOIN verified_mints m ON m.pubkey = t.mint
            GROUP BY a.pubkey, a.lamports""",
    ),
    "sql_distinct_holders": _over(
        "tokens verified", "SELECT mint, count(DISTINCT owner) AS holders FROM verified GROUP BY mint"
    ),
    "sql_approx_holders": _over(
        "tokens verified", "SELECT mint, count(DISTINCT owner) AS holders, true AS near FROM verified GROUP BY mint"
    ),
    "sql_owner_state_rollup": _over(
        "tokens verified",
        """SELECT state::INTEGER AS state, native, count(*) AS accounts, sum(amount)::VARCHAR AS amount
           FROM (SELECT *, is_native IS NOT NULL AS native FROM verified) GROUP BY ROLLUP (state, native)""",
    ),
    "sql_cube_accounts": _over(
        "n records versions",
        f"""SELECT owner, executable, count(*) AS accounts, sum(lamports)::VARCHAR AS lamports
            FROM (SELECT owner, executable = 1 AS executable, lamports FROM versions WHERE {_ALIVE})
            GROUP BY CUBE (owner, executable)""",
    ),
    "sql_grouping_sets": _over(
        "mints verified_mints",
        """SELECT decimals::INTEGER AS decimals, is_initialized, grouping(decimals)::INTEGER AS all_decimals,
                  grouping(is_initialized)::INTEGER AS all_initialized, count(*) AS mints
           FROM verified_mints GROUP BY GROUPING SETS ((decimals), (is_initialized), ())""",
    ),
    "sql_holder_rank": _over(
        "tokens verified",
        f"""SELECT mint, pubkey, amount::VARCHAR AS amount, row_number() OVER ({_HELD_ORDER}) AS place,
                   rank() OVER (PARTITION BY mint ORDER BY amount DESC) AS rank FROM verified""",
    ),
    "sql_running_amount": _over(
        "tokens verified",
        f"""SELECT mint, pubkey, amount::VARCHAR AS amount,
                   sum(amount) OVER ({_HELD_ORDER} ROWS UNBOUNDED PRECEDING)::VARCHAR AS running FROM verified""",
    ),
    "sql_lag_amount": _over(
        "tokens verified",
        f"SELECT mint, pubkey, amount::VARCHAR AS amount, (lag(amount) OVER ({_HELD_ORDER}))::VARCHAR AS previous FROM verified",
    ),
    "sql_owner_setops": _over(
        "n records versions tokens verified",
        f"""SELECT owner, 'union' AS set FROM (
              SELECT owner FROM verified UNION SELECT pubkey FROM versions WHERE {_ALIVE})
            UNION ALL
            SELECT owner, 'intersect' FROM (
              SELECT owner FROM verified INTERSECT SELECT pubkey FROM versions WHERE {_ALIVE})
            UNION ALL
            SELECT pubkey, 'except' FROM (
              SELECT pubkey FROM versions WHERE {_ALIVE} EXCEPT SELECT owner FROM verified)""",
    ),
    "sql_theta_range": _over(
        "tokens verified",
        """SELECT band, count(*) AS accounts, sum(amount)::HUGEINT::VARCHAR AS amount
           FROM verified JOIN (VALUES ('dust', 0, 5000), ('small', 5000, 20000), ('medium', 15000, 35000),
                                      ('large', 35000, 18446744073709551616)) AS b(band, low, high)
             ON amount >= low AND amount < high
           GROUP BY band""",
    ),
    "sql_scalar_subquery": _over(
        "tokens verified",
        """SELECT mint, pubkey, amount::VARCHAR AS amount FROM verified t
           WHERE amount = (SELECT max(amount) FROM verified s WHERE s.mint = t.mint)""",
    ),
    "sql_formatted": _over(
        "mints tokens verified verified_mints",
        """SELECT m.pubkey AS mint, decimals::VARCHAR AS decimals, is_initialized::VARCHAR AS is_initialized,
                  supply::VARCHAR AS supply, printf('%.4f', supply::DOUBLE / 7000::DOUBLE) AS scaled,
                  printf('%.4f', decimals::DOUBLE) AS decimals_float, coalesce(mint_authority, 'NULL') AS authority,
                  t.pubkey AS token, t.amount::VARCHAR AS amount
           FROM verified_mints m JOIN verified t ON t.mint = m.pubkey""",
    ),
    "sql_correlated_maximum": _over(
        "tokens verified",
        """SELECT mint, pubkey, amount::VARCHAR AS amount FROM verified t
           WHERE amount = (SELECT max(amount) FROM verified s WHERE s.mint = t.mint)""",
    ),
    "top_distinct_holders": _over(
        "tokens verified",
        """SELECT mint, count(DISTINCT owner) AS holders FROM verified
           GROUP BY mint ORDER BY holders DESC, mint LIMIT 10""",
    ),
}
