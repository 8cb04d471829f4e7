"""The same queries as SQL over the given tables."""

from __future__ import annotations

from fleetlens.plans.queries import EXCLUDED, FOUND, TOKEN_NOW

_LISTING = """listing AS (
  SELECT sha1(text) AS hash, octet_length(encode(text)) AS size, doc_id FROM documents
)"""

_REPEATED = """repeated AS (
  SELECT hash, count(*) AS n, min(size) AS size FROM listing WHERE size > 0 GROUP BY hash HAVING count(*) > 1
)"""

_SIZES = """sizes AS (SELECT octet_length(encode(text)) AS size, doc_id FROM documents),
candidates AS (SELECT size, count(*) AS n FROM sizes WHERE size > 0 GROUP BY size HAVING count(*) > 1)"""

_FILES = """files AS (
  SELECT '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
         octet_length(encode(html)) AS size, page_id
  FROM pages
)"""

_NODES = (
    _FILES
    + """, parts AS (
  SELECT list_filter(string_split(path, '/'), lambda x: length(x) > 0) AS parts, size, page_id FROM files
), levels AS (
  SELECT '/' || array_to_string(parts[1:d], '/') AS path, d AS depth, d < len(parts) AS above, size, page_id, parts
  FROM parts, unnest(range(1, len(parts) + 1)) AS u(d)
), nodes AS (
  SELECT path, CASE WHEN depth = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
         regexp_extract(path, '([^/]*)$', 1) AS name, depth::INT AS depth, bool_or(above) AS is_dir,
         CASE WHEN bool_or(above) THEN 0 ELSE arg_min(size, page_id) FILTER (WHERE NOT above) END AS size
  FROM levels GROUP BY path, depth
)"""
)


def _any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


_LATENCY = """latencies AS (
  SELECT event_id, ts, user_id::VARCHAR AS addr, user_id,
         CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'global' END AS network, value AS time
  FROM events
)"""


def _bucket(width: str, where: str = "true", ts: str = "ts") -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', {ts}) AS time_bucket, count(*) AS count, avg(time) AS avg,
       max(time) AS max, median(time) AS median FROM latencies WHERE {where} GROUP BY 1"""


def _rounded(source: str, more: str = "") -> str:
    return f"""SELECT {more} time_bucket, count, round(avg, 9) AS avg, round(max, 6) AS max, round(median, 6) AS median
FROM ({source})"""


_QUARTERS = (
    _LATENCY
    + f""", stats AS ({_bucket('6 hours')}), total AS (
  SELECT min(avg) AS min_avg, max(avg) AS max_avg, sum(avg) AS avg_sum, stddev_samp(avg) AS std_dev,
         count(*) AS total_pings, avg(avg) AS total_avg FROM stats
), slow AS (SELECT * FROM stats, total WHERE avg - total_avg > std_dev)"""
)

_SAMPLES = """samples AS (
  SELECT event_id, ts, user_id AS cpu, round(value * 100)::BIGINT AS total,
         CASE WHEN event_type = 'view' THEN round(value * 100)::BIGINT ELSE 0 END AS idle
  FROM events
)"""

_COUNTERS = (
    _SAMPLES
    + """, counters AS (
  SELECT event_id, ts, cpu, (sum(total) OVER w)::BIGINT AS total, (sum(idle) OVER w)::BIGINT AS idle
  FROM samples WINDOW w AS (PARTITION BY cpu ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
)"""
)

_DELTAS = """(total - lag(total) OVER (PARTITION BY cpu ORDER BY ts, event_id))::{t} AS d_total,
       (idle - lag(idle) OVER (PARTITION BY cpu ORDER BY ts, event_id))::{t} AS d_idle"""


def _lookback(us: int, edge: bool, key: str = "event_id", clock: str = "epoch_us(ts)") -> str:
    """Sum and count of the recent rows, and the last row that is older."""
    plus = "coalesce({c}_edge, 0)" if edge else "0"
    more = "(total_edge IS NOT NULL)::INT" if edge else "0"
    mean = ", ".join(
        f"round(({c}_sum + {plus.format(c=c)}) / (n + {more}), 6) AS mean_{c}" for c in ("total", "idle")
    )
    return f"""timed AS (SELECT *, {clock} AS t FROM samples), framed AS (
  SELECT *, count(*) OVER recent AS n, sum(total) OVER recent AS total_sum, sum(idle) OVER recent AS idle_sum,
         arg_max(total, (t, event_id)) OVER older AS total_edge, arg_max(idle, (t, event_id)) OVER older AS idle_edge
  FROM timed WINDOW
    recent AS (PARTITION BY cpu ORDER BY t RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW),
    older AS (PARTITION BY cpu ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {us} PRECEDING)
) SELECT {key}, cpu, {mean} FROM framed"""


_HOUR_US = 3_600_000_000

_WORDS = r"""words AS (
  SELECT word, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY word
)"""

_TURN_WORDS = r"""turn_words AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM conversations)"""


def _digits(col: str) -> str:
    return (
        f"translate(regexp_replace(lower({col}), '[^a-z@ ]', '?', 'g'), "
        "'@abcdefghijklmnopqrstuvwxyz ', '1222333444555666777788899990')"
    )


_INDEX = (
    _WORDS
    + f""", indexed AS (
  SELECT substr(digits, 1, i) AS prefix, word, n
  FROM (SELECT word, n, {_digits('word')} AS digits FROM words), unnest(range(1, length(digits) + 1)) AS u(i)
)"""
)

_TYPED = f"typed AS (SELECT DISTINCT {_digits('substr(event_type, 1, 3)')} AS prefix FROM events)"

_SYMBOLS = """symbols AS (
  SELECT symbol, count(*) AS freq FROM (SELECT unnest(string_split(text, '')) AS symbol FROM documents)
  WHERE length(symbol) > 0 GROUP BY symbol
)"""

_TOKENS = """tokens AS (
  SELECT o_orderkey, o_custkey::VARCHAR AS user_id, 'ünïcode?>~' || o_orderpriority AS user_name,
         o_orderkey AS jwt_session_id, epoch(o_orderdate)::BIGINT AS iat,
         epoch(o_orderdate)::BIGINT + (o_orderkey % 12 + 1) * 2592000 AS exp
  FROM orders
)"""

_STATUS = f"""CASE WHEN exp <= {TOKEN_NOW} THEN 'expired'
     WHEN (exp - {TOKEN_NOW}) * 2 < exp - iat THEN 'renew' ELSE 'valid' END"""

_RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS project,
         CASE WHEN o_orderkey % 3 > 0 THEN 'suite ' || o_custkey ELSE '' END AS suite, 'test ' || o_orderkey AS name,
         CASE WHEN o_orderkey % 5 = 0 THEN 'suite' ELSE 'test' END AS type,
         CASE WHEN o_orderstatus <> 'P' THEN 'run' WHEN o_orderkey % 2 = 0 THEN 'skip' ELSE 'todo' END AS mode,
         CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' END AS state, o_totalprice AS duration,
         CASE WHEN o_custkey % 40 = 0 THEN '' ELSE 'at line ' || (o_custkey % 40) END AS stack
  FROM orders
)"""


def _fixed(value: str, digits: int) -> str:
    """Exact value, ties up: printf rounds a tie to even, so those are lifted first."""
    tie = f"(abs({value}) * {2 ** (digits + 1)}) % 2 = 1"
    lifted = f"printf('%.{digits}f', {value} + {10.0 ** -(digits + 2)})"
    return f"CASE WHEN {tie} THEN {lifted} ELSE printf('%.{digits}f', {value}) END"


def _units(value: str, units: list[tuple[int, str]], op: str, last: tuple[str, str]) -> tuple[str, str]:
    shown = " ".join(f"WHEN {value} {op} {u} THEN {value} / {u}" for u, _ in units)
    label = " ".join(f"WHEN {value} {op} {u} THEN '{n}'" for u, n in units)
    return f"CASE {shown} ELSE {last[0]} END", f"CASE {label} ELSE '{last[1]}' END"


_BYTES = _units("x", [(1024**3, "gb"), (1024**2, "mb"), (1024, "kb")], ">", ("x", "b"))
_TIMES = _units("x", [(3_600_000, "h"), (60_000, "m"), (1000, "s"), (1, "ms")], ">=", ("x * 1000", "µs"))

_CLOSED = "time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"

SQL: dict[str, str] = {
    "dup_documents": f"""WITH {_LISTING} SELECT hash, size, doc_id FROM
        (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM listing WHERE size > 0)
        WHERE n > 1 ORDER BY size DESC, hash, doc_id""",
    "dup_documents_short_hash": f"""WITH {_LISTING} SELECT substr(hash, 1, 10) AS hash, size, doc_id FROM
        (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM listing WHERE size > 0) WHERE n > 1""",
    "hash_counts": f"""WITH {_LISTING}
        SELECT hash, count(*) AS n, min(size) AS size FROM listing WHERE size > 0 GROUP BY hash""",
    "dup_groups": f"""WITH {_LISTING} SELECT hash, n, doc_id FROM
        (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM listing WHERE size > 0) WHERE n > 1""",
    "dup_group_parts": f"""WITH {_LISTING} SELECT hash, count(*) AS n, count(*) AS listed,
        sum(doc_id)::BIGINT AS id_sum FROM listing WHERE size > 0 GROUP BY hash HAVING count(*) > 1""",
    "dup_summary": f"WITH {_LISTING}, {_REPEATED} SELECT count(*) AS groups, sum(n)::BIGINT AS rows FROM repeated",
    "hash_sizes": f"WITH {_LISTING}, {_REPEATED} SELECT hash, size FROM repeated",
    "largest_dup": f"WITH {_LISTING}, {_REPEATED} SELECT size, hash FROM repeated ORDER BY size DESC, hash LIMIT 1",
    "size_histogram": f"WITH {_SIZES} SELECT size, count(*) AS n FROM sizes GROUP BY size",
    "quantity_histogram": "SELECT l_quantity AS size, count(*) AS n FROM lineitem GROUP BY l_quantity",
    "size_candidates": f"WITH {_SIZES} SELECT size, n FROM candidates",
    "candidate_count": f"WITH {_SIZES} SELECT sum(n)::BIGINT AS n FROM candidates",
    "candidate_rows": f"WITH {_SIZES} SELECT size, doc_id FROM sizes WHERE size IN (SELECT size FROM candidates)",
    "size_groups": f"""WITH {_SIZES} SELECT size, n, doc_id FROM
        (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM sizes WHERE size > 0) WHERE n > 1""",
    "extension_stats": f"""WITH {_FILES}, named AS (
          SELECT regexp_extract(path, '([^/]*)/*$', 1) AS name, size FROM files)
        SELECT CASE WHEN name = '..' THEN '' ELSE regexp_extract(name, '^.+(\\.[^.]*)$', 1) END AS ext,
          count(*) AS n, sum(size)::BIGINT AS bytes FROM named GROUP BY 1""",
    "path_nodes": f"WITH {_NODES} SELECT path, parent, name, depth, is_dir, size FROM nodes",
    "leaf_paths": f"WITH {_NODES} SELECT path, size FROM nodes WHERE path NOT IN (SELECT parent FROM nodes)",
    "childless_nodes": f"WITH {_NODES} SELECT path, size FROM nodes WHERE path NOT IN (SELECT parent FROM nodes)",
    "shallowest_files": f"""WITH {_NODES} SELECT depth, path, size FROM nodes WHERE NOT is_dir
        ORDER BY depth, path LIMIT 151""",
    "exclude_paths": f"""WITH {_NODES} SELECT path, is_dir, size FROM nodes
        WHERE NOT {_any('parent', EXCLUDED)} AND (is_dir OR NOT {_any('path', EXCLUDED)})""",
    "outermost_dirs": f"""WITH {_NODES} SELECT path FROM nodes WHERE is_dir AND {_any('path', FOUND)}
        AND NOT {_any('parent', EXCLUDED + FOUND)}""",
    "find_and_exclude": f"""WITH {_NODES} SELECT path, is_dir FROM nodes WHERE NOT {_any('parent', EXCLUDED + FOUND)}
        AND CASE WHEN is_dir THEN {_any('path', FOUND)} ELSE NOT {_any('path', EXCLUDED)} END""",
    "split_files": f"WITH {_NODES} SELECT size, path FROM nodes WHERE NOT is_dir",
    "split_dirs": f"WITH {_NODES} SELECT path FROM nodes WHERE is_dir",
    "scan_counts": f"""WITH {_NODES} SELECT count(*) FILTER (WHERE NOT is_dir) AS files,
        count(*) FILTER (WHERE is_dir) AS dirs FROM nodes""",
    "size_listing_roundtrip": f"WITH {_FILES} SELECT size, path FROM files",
    "hash_listing_roundtrip": f"WITH {_LISTING} SELECT hash, size, doc_id::VARCHAR AS path FROM listing",
    "scan_files": "SELECT lang, octet_length(encode(text)) + 1 AS size, false AS is_dir FROM documents",
    "scan_objects": "SELECT lang, octet_length(encode(text)) + 1 AS size FROM documents",
    "dup_objects": """SELECT hash, size, doc_id FROM (
          SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM (
            SELECT doc_id, sha1(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS size FROM documents)
          WHERE size > 0) WHERE n > 1""",
    "scan_two_roots": """WITH named AS (
          SELECT ['', '.', '_'][(doc_id % 3 + 1)::INT] || lang AS folder, ['', '.', '_ '][(doc_id % 3 + 1)::INT] || doc_id || '%20.txt' AS file,
            octet_length(encode(coalesce(text, ''))) AS size FROM documents)
        SELECT folder || '/' || file AS name, false AS is_dir, size FROM named
        UNION ALL SELECT DISTINCT folder, true, NULL FROM named""",
    "unreadable_files": """SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN sha1(coalesce(text, '')) END AS hash,
          octet_length(encode(coalesce(text, ''))) AS size, CASE WHEN doc_id % 3 = 2 THEN 'ENOENT' END AS error FROM documents""",
    "dup_files": """SELECT hash, size, lang FROM (
          SELECT sha1(text || chr(10)) AS hash, octet_length(encode(text)) + 1 AS size, lang,
            count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""",
    "ping_parse": """SELECT event_id, (user_id % 64 + 56)::INT AS bytes,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS addr, event_id AS seq,
        (event_id % 200 + 30)::INT AS ttl, value AS time, 'ms' AS time_unit
        FROM events WHERE event_type <> 'signup'""",
    "bucket_stats_6h": f"WITH {_LATENCY} {_rounded(_bucket('6 hours'))}",
    "bucket_stats_1d": f"WITH {_LATENCY} {_rounded(_bucket('1 day'))}",
    "bucket_stats_1w": f"WITH {_LATENCY} {_rounded(_bucket('7 days'))}",
    "bucket_stats_by_addr": f"""WITH {_LATENCY} SELECT addr, time_bucket(INTERVAL '7 days', ts) AS time_bucket,
        count(*) AS count, round(avg(time), 9) AS avg, round(max(time), 6) AS max, round(median(time), 6) AS median
        FROM latencies GROUP BY 1, 2""",
    "bucket_stats_null_addr": f"""WITH {_LATENCY} SELECT CASE WHEN user_id % 7 > 0 THEN addr END AS addr,
        time_bucket(INTERVAL '7 days', ts) AS time_bucket, count(*) AS count, round(avg(time), 9) AS avg,
        round(max(time), 6) AS max, round(median(time), 6) AS median FROM latencies GROUP BY 1, 2""",
    "agg_stats": f"""WITH {_QUARTERS} SELECT round(min_avg, 6) AS min_avg, round(max_avg, 6) AS max_avg,
        round(avg_sum, 6) AS avg_sum, round(std_dev, 6) AS std_dev, total_pings, round(total_avg, 6) AS total_avg
        FROM total""",
    "outliers": f"WITH {_QUARTERS} {_rounded('SELECT * FROM slow')}",
    "weekly_order": f"""WITH {_QUARTERS} SELECT time_bucket, dayofweek(time_bucket)::INT AS weekday,
        strftime(time_bucket, '%H%M') AS clock, day(time_bucket)::INT AS day FROM stats ORDER BY 2, 3, 4, 1""",
    "report_lines": f"""WITH {_QUARTERS} SELECT time_bucket, strftime(time_bucket, '%a [%m-%d-%Y] %I:%M %p') || ' ' ||
        repeat('=', floor((avg - min_avg) / (max_avg - min_avg) * 50 + 0.5)::BIGINT) || ' ' ||
        {_fixed('avg', 3)} AS line FROM slow""",
    "report_header": f"""WITH {_QUARTERS} SELECT '{{"maxAvg":' || round(max_avg, 4) || ',"minAvg":' ||
        round(min_avg, 4) || ',"totalAvg":' || round(total_avg, 4) || ',"totalAvgFixed":' ||
        (floor(round(total_avg, 4) * 1000 + 0.5) / 1000) || ',"stdDev":' || round(std_dev, 4) || '}}' AS header
        FROM total""",
    "by_network": f"""WITH {_LATENCY} {_rounded(_bucket('1 day', "network = 'local'"))}""",
    "since_7d": f"""WITH {_LATENCY} {_rounded(_bucket('1 day', "ts >= TIMESTAMP '2024-01-30' - INTERVAL '7 days'"))}""",
    "resolve_address": """SELECT event_id, user_id::VARCHAR AS addr, c_custkey + 1000 AS addr_id
        FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) ON c_custkey = user_id""",
    "stats_for_addr": f"""WITH {_LATENCY} {_rounded(_bucket('1 day', "addr = '4' AND network = 'local'"))}""",
    "stats_for_unknown_addr_compat": f"""WITH {_LATENCY} {_rounded(_bucket('1 day', "network = 'global'"))}""",
    "sample_every": f"""WITH {_LATENCY} SELECT slot, event_id, ts, addr, time FROM (
          SELECT *, time_bucket(INTERVAL '1 hour', ts) AS slot,
            row_number() OVER (PARTITION BY addr, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts DESC, event_id DESC) AS rn
          FROM latencies) WHERE rn = 1""",
    "measurements_roundtrip": """SELECT event_id, ts, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS addr,
        event_id AS seq, value AS time, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type <> 'signup'""",
    "network_roundtrip": f"""WITH {_LATENCY} SELECT CASE WHEN event_id % 7 > 0 THEN network ELSE 'default' END AS network,
        count(*) AS n, max(event_id) AS last FROM latencies GROUP BY 1""",
    "bucket_stats_roundtrip": f"WITH {_LATENCY} {_rounded(_bucket('6 hours'))}",
    "cpu_totals": """SELECT l_orderkey, sum(l_partkey + l_suppkey + l_quantity::BIGINT + l_linenumber)::BIGINT AS total,
        sum(l_quantity::BIGINT)::BIGINT AS idle FROM lineitem GROUP BY l_orderkey""",
    "cpu_deltas": f"""WITH {_COUNTERS} SELECT event_id, cpu, total, idle, {_DELTAS.format(t='BIGINT')} FROM counters""",
    "lookback_mean": f"WITH {_SAMPLES}, {_lookback(6 * _HOUR_US, True)}",
    "lookback_mean_no_edge": f"WITH {_SAMPLES}, {_lookback(6 * _HOUR_US, False)}",
    "utilization": f"""WITH {_SAMPLES}, used AS (
          SELECT cpu, strftime(ts, '%Y-%m-%d') AS day, 1.0::DOUBLE - sum(idle)::DOUBLE / nullif(sum(total)::DOUBLE, 0) AS busy
          FROM samples GROUP BY 1, 2)
        SELECT cpu, day, floor(busy * 10000 + 0.5) / 100 AS utilization,
          rpad(repeat('=', floor(busy * 30 + 0.5)::BIGINT), 31, ' ') AS bar FROM used""",
    "cpu_report": f"""SELECT event_id, floor((1.0::DOUBLE - mean_idle / nullif(mean_total, 0)) * 10000 + 0.5) / 100
        AS utilization FROM (WITH {_SAMPLES}, {_lookback(12 * _HOUR_US, True).replace(', 6) AS', ', 20) AS')})""",
    "running_extrema": """SELECT event_id, event_type AS gauge, value, min(value) OVER w AS min_so_far,
        max(value) OVER w AS max_so_far FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "gauge_extrema": """SELECT event_type AS gauge, arg_max(value, (ts, event_id)) AS current, min(value) AS min,
        max(value) AS max FROM events GROUP BY event_type""",
    "running_total": f"WITH {_COUNTERS} SELECT event_id, total, idle FROM counters",
    "keep_newest": """WITH span AS (SELECT count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events)
        SELECT event_id FROM events, span WHERE n <= 1000 OR epoch_us(ts) >= a + (b - a) / 2""",
    "keep_newest_by_cpu": """WITH span AS (
          SELECT user_id AS cpu, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1)
        SELECT event_id, cpu FROM events JOIN span ON cpu = user_id WHERE n <= 60 OR epoch_us(ts) >= a + (b - a) / 2""",
    "keep_newest_null_cpu": """WITH named AS (
          SELECT event_id, ts, CASE WHEN user_id % 7 > 0 THEN user_id END AS cpu FROM events),
        span AS (SELECT cpu, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM named GROUP BY 1)
        SELECT event_id, named.cpu FROM named JOIN span ON named.cpu IS NOT DISTINCT FROM span.cpu
        WHERE n <= 60 OR epoch_us(ts) >= a + (b - a) / 2""",
    "network_two_writes": f"WITH {_LATENCY} SELECT network, count(*) AS n FROM latencies GROUP BY 1",
    "sample_counts": """SELECT event_type AS gauge, count(*) AS seen, count(*) FILTER (WHERE value > 50) AS kept,
        count(*) FILTER (WHERE event_id % 2 = 0) AS drawn FROM events GROUP BY event_type""",
    "corpus_words": f"WITH {_WORDS} SELECT word, n FROM words",
    "word_digits": f"WITH {_WORDS} SELECT word, {_digits('word')} AS digits FROM words",
    "key_digits": """SELECT c_custkey, translate(c_custkey::VARCHAR, '1234567890', 'qweasdzxc ') AS typed,
        c_custkey::VARCHAR AS digits FROM customer""",
    "word_frequencies": f"""WITH {_WORDS}, {_TURN_WORDS}
        SELECT word, n FROM words WHERE word IN (SELECT word FROM turn_words)""",
    "words_with_frequency": f"""WITH {_WORDS}, {_TURN_WORDS} SELECT word, coalesce(n, 0) AS n, count(*) AS occurrences
        FROM turn_words LEFT JOIN words USING (word) GROUP BY ALL""",
    "prefix_index": f"WITH {_INDEX} SELECT prefix, word FROM indexed",
    "prefix_lookup": f"WITH {_INDEX}, {_TYPED} SELECT prefix, word, n FROM indexed JOIN typed USING (prefix)",
    "stored_prefix_lookup": f"WITH {_INDEX}, {_TYPED} SELECT prefix, word, n FROM indexed JOIN typed USING (prefix)",
    "rank_words": f"""WITH {_INDEX} SELECT prefix, word, n,
        row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word) AS rn FROM indexed""",
    "top_words": f"""WITH {_INDEX} SELECT prefix, word, n, rn::INT AS rn FROM (SELECT prefix, word, n,
        row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word) AS rn FROM indexed) WHERE rn <= 10""",
    "keypad_report": f"""WITH {_INDEX}, {_TYPED}, {_TURN_WORDS}, spoken AS (SELECT DISTINCT word FROM turn_words),
        known AS (SELECT word, coalesce(n, 0) AS n, {_digits('word')} AS digits FROM spoken LEFT JOIN words USING (word))
        SELECT prefix, word, n, rn::INT AS rn FROM (SELECT prefix, word, n,
        row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word) AS rn
        FROM known JOIN typed ON starts_with(digits, prefix)) WHERE rn <= 10""",
    "word_count_roundtrip": f"WITH {_WORDS} SELECT word, n::DOUBLE AS n FROM words WHERE regexp_matches(word, '[a-zA-Z]')",
    "word_lines": r"""SELECT line, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))),
        '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE length(line) > 0 GROUP BY line""",
    # Joining the two smallest weights until one is left costs their sum each time: the least number of bits.
    "size_report": f"""WITH RECURSIVE {_SYMBOLS}, joined AS (
          SELECT list_sort(list(freq::BIGINT)) AS weights, 0::BIGINT AS bits FROM symbols
          UNION ALL
          SELECT list_sort(list_append(weights[3:], weights[1] + weights[2])), bits + weights[1] + weights[2]
          FROM joined WHERE len(weights) > 1)
        SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT sum(freq)::BIGINT FROM symbols) AS raw_length,
          max(bits) AS encoded_bits, ceil(max(bits) / 8)::BIGINT AS encoded_length FROM joined""",
    "symbol_histogram": f"WITH {_SYMBOLS} SELECT symbol, freq FROM symbols",
    "codebook_kraft": f"WITH {_SYMBOLS} SELECT count(*) AS symbols, 1.0::DOUBLE AS kraft FROM symbols",
    "encode_roundtrip": "SELECT doc_id, text FROM documents",
    "chunk_words": """WITH split AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
        SELECT conv_id, turn, pos, array_to_string(w[pos * 8 + 1 : pos * 8 + 8], ',') AS words
        FROM split, unnest(range(0, (len(w) + 7) // 8)) AS u(pos)""",
    "user_keys": """SELECT c_custkey AS user_id, c_name AS user_name,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS key_idx, o_orderkey AS key_id,
        o_orderpriority || '-' || o_orderkey AS key_text FROM orders JOIN customer ON c_custkey = o_custkey""",
    "decrypt_roundtrip": """SELECT o_orderkey AS key_id, c_name AS user_name,
        (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || ': ' || o_orderpriority || '-' ||
        o_orderkey AS line FROM orders JOIN customer ON c_custkey = o_custkey""",
    "token_status": f"WITH {_TOKENS} SELECT *, {_STATUS} AS status FROM tokens",
    "token_renewals": f"WITH {_TOKENS} SELECT o_orderkey, exp FROM tokens WHERE {_STATUS} = 'renew'",
    "status_rollup": f"""WITH {_RUNS} SELECT project, count(*) AS total, count(*) FILTER (WHERE state = 'pass') AS passed,
        count(*) FILTER (WHERE state = 'fail') AS failed,
        count(*) FILTER (WHERE state IS NULL AND mode = 'skip') AS skipped,
        count(*) FILTER (WHERE state IS NULL AND mode = 'todo') AS todo,
        max(duration) FILTER (WHERE type = 'suite') AS max_duration,
        round(sum(duration) FILTER (WHERE type = 'suite'), 2) AS sum_duration FROM runs GROUP BY project""",
    "error_groups": f"""WITH {_RUNS} SELECT stack, project, run_id, count(*) OVER (PARTITION BY stack, project, own) AS n
        FROM (SELECT stack, CASE WHEN type = 'suite' THEN project ELSE '' END AS project, run_id,
            CASE WHEN stack = '' THEN run_id END AS own FROM runs WHERE state = 'fail')""",
    "suite_durations": f"""WITH {_RUNS} SELECT project, count(*) FILTER (WHERE own) AS files, {', '.join(
        f"round(coalesce({how}({w} * duration) FILTER (WHERE own), 0), 2) AS {how}_{p}"
        for p, w in (("collect", 3), ("setup", 2), ("tests", 5), ("environment", 1), ("prepare", 4), ("thread", 10))
        for how in ("max", "sum"))}
        FROM (SELECT *, type = 'suite' AND suite <> '' AS own FROM runs) GROUP BY project""",
    "error_messages": f"""WITH {_RUNS} SELECT stack, project, first(message ORDER BY run_id) AS message, count(*) AS n, min(run_id) AS run_id
        FROM (SELECT stack, CASE WHEN type = 'suite' THEN project ELSE '' END AS project, project AS message, run_id,
            CASE WHEN stack = '' THEN run_id END AS own FROM runs WHERE state = 'fail') GROUP BY stack, project, own""",
    "failure_summary": f"""WITH {_RUNS} SELECT count(*) FILTER (WHERE type = 'suite') AS failed_suites,
        count(*) FILTER (WHERE type = 'test') AS failed_tests, count(*) FILTER (WHERE type = 'suite') AS suite_errors,
        count(*) FILTER (WHERE type = 'test') AS test_errors FROM runs WHERE state = 'fail'""",
    "skipped_first": f"""WITH {_RUNS} SELECT run_id, mode IN ('skip', 'todo') AS skipped FROM runs
        ORDER BY skipped DESC, run_id""",
    "full_name": f"""WITH {_RUNS} SELECT run_id, concat_ws(' > ', project, nullif(suite, ''), name) AS full_name
        FROM runs""",
    "human_bytes": f"""WITH sized AS (SELECT doc_id, (n_chars * (64 ** (doc_id % 4))::BIGINT)::DOUBLE AS x FROM documents),
        shown AS (SELECT doc_id, {_BYTES[0]} AS v, {_BYTES[1]} AS unit FROM sized)
        SELECT doc_id, {_fixed('v', 3)} || ' ' || unit AS size_text FROM shown""",
    "human_time": f"""WITH timed AS (SELECT event_id, value * (30.0::DOUBLE ** (event_id % 5)) / 50 AS x FROM events),
        shown AS (SELECT event_id, {_TIMES[0]} AS v, {_TIMES[1]} AS unit FROM timed)
        SELECT event_id, CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE {_fixed('v', 3)} END || ' ' || unit AS time_text,
          {_fixed('v', 1)} || ' ' || unit AS short FROM shown""",
    "date_formats": """SELECT event_id, strftime(ts, '[%m-%d-%Y] %I:%M %p') AS report,
        strftime(ts, '%m%d%Y_') || lpad((CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END)::VARCHAR, 2, '0') ||
        strftime(ts, '%M') AS file, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS lexical,
        strftime(ts, '[%m-%d-%Y] %H:%M:%S.%g') AS debug, strftime(ts, '%a') AS day, strftime(ts, '%H:%M:%S') AS clock
        FROM events""",
    "stream_bucket_stats": f"WITH {_LATENCY} {_rounded(_bucket('6 hours', _CLOSED))}",
    "stream_bucket_stats_7d": f"""WITH {_LATENCY} {_rounded(_bucket('7 days',
        "time_bucket(INTERVAL '7 days', ts) + INTERVAL '7 days' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"))}""",
    "stream_sample_weekly": """SELECT slot, event_id, ts, user_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, event_id DESC) AS rn FROM (
            SELECT *, date_trunc('week', ts)::TIMESTAMP AS slot FROM events))
        WHERE rn = 1 AND slot + INTERVAL '7 days' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
    "stream_deltas_over": f"""WITH {_COUNTERS}, gone AS (
          SELECT *, epoch_us(ts) AS t, epoch_us(lag(ts) OVER (PARTITION BY cpu ORDER BY ts, event_id)) AS before,
            {_DELTAS.format(t='BIGINT')} FROM counters)
        SELECT cpu, t, total, idle, CASE WHEN t - before <= 86400000000 THEN d_total END AS d_total,
            CASE WHEN t - before <= 86400000000 THEN d_idle END AS d_idle FROM gone""",
    "stream_lookback_over": f"""WITH {_SAMPLES}, started AS (
          SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY cpu ORDER BY ts, event_id) <= 86400000000
            THEN 0 ELSE 1 END AS start FROM samples),
        parts AS (SELECT * REPLACE (cpu * 100000 + part AS cpu) FROM (
          SELECT *, sum(start) OVER (PARTITION BY cpu ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM started))
        SELECT (cpu // 100000)::BIGINT AS cpu, t, mean_total, mean_idle FROM (
          WITH samples AS (SELECT * FROM parts), {_lookback(6 * _HOUR_US, True, "t", "epoch_us(ts)")})""",
    "stream_measurements_checked": """SELECT event_id AS seq, addr, value AS time,
          CASE WHEN event_id % 10 = 0 THEN 'expected 10.9.9.9, reply from ' || addr END AS error
        FROM (SELECT *, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS addr FROM events)
        WHERE event_type <> 'signup'""",
    "stream_sample_every": """SELECT slot, event_id, ts, user_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, event_id DESC) AS rn FROM (
            SELECT *, time_bucket(INTERVAL '1 hour', ts) AS slot FROM events))
        WHERE rn = 1 AND slot + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
    "stream_running_extrema": """SELECT event_type AS gauge, arg_max(value, (ts, event_id)) AS current,
        min(value) AS min, max(value) AS max FROM events GROUP BY event_type""",
    "stream_sample_counts": "SELECT event_type, count(*) AS seen FROM events GROUP BY event_type",
    "stream_counter_deltas": f"""WITH {_COUNTERS} SELECT cpu, epoch_us(ts) // 1000 AS t, total::DOUBLE AS total,
        idle::DOUBLE AS idle, {_DELTAS.format(t='DOUBLE')} FROM counters""",
    "stream_lookback": f"""WITH {_SAMPLES}, {_lookback(6 * 3_600_000, True, "t", "epoch_us(ts) // 1000")}""",
    "append_counter_deltas": f"""WITH {_COUNTERS} SELECT cpu, epoch_us(ts) // 1000 AS t, total::DOUBLE AS total,
        idle::DOUBLE AS idle, {_DELTAS.format(t='DOUBLE')} FROM counters""",
    "append_lookback": f"""WITH {_SAMPLES}, {_lookback(6 * 3_600_000, True, "t", "epoch_us(ts) // 1000")}""",
    "stream_sample_gap": """WITH RECURSIVE seen AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events),
        kept AS (
          SELECT user_id, min(t) AS t FROM seen GROUP BY user_id
          UNION ALL
          SELECT seen.user_id, min(seen.t) AS t FROM kept JOIN seen
          ON seen.user_id = kept.user_id AND seen.t > kept.t + 21600000 GROUP BY seen.user_id
        ) SELECT user_id, t FROM kept""",
    "sample_gap": """WITH RECURSIVE seen AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events),
        kept AS (
          SELECT user_id, min(t) AS t FROM seen GROUP BY user_id
          UNION ALL
          SELECT seen.user_id, min(seen.t) AS t FROM kept JOIN seen
          ON seen.user_id = kept.user_id AND seen.t > kept.t + 21600000 GROUP BY seen.user_id
        ) SELECT user_id, t FROM kept""",
    "sample_gap_all": """WITH RECURSIVE seen AS (SELECT event_id, epoch_us(ts) AS us FROM events),
        kept AS (
          SELECT min(us) AS us FROM seen
          UNION ALL
          SELECT (SELECT min(seen.us) FROM seen WHERE seen.us > kept.us + 1800000000) AS us FROM kept WHERE us IS NOT NULL
        ) SELECT min(event_id) AS event_id, kept.us // 1000 AS t FROM kept JOIN seen ON seen.us = kept.us GROUP BY kept.us""",
    "stream_measurements": """SELECT '10.1.0.1' AS src_addr, (user_id % 64 + 56)::INT AS bytes,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS addr, event_id AS seq,
        (event_id % 200 + 30)::INT AS ttl, value AS time, 'ms' AS time_unit
        FROM events WHERE event_type <> 'signup'""",
}
