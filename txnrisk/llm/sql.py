"""DuckDB SQL for the operators of this subpackage that SQL can express."""

SHARDING = """
    WITH rows_ AS (
        SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
               lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':'
                    || md5(coalesce(text, ''))), 1, 15) AS BIGINT)), 60, '0') AS bits
        FROM documents),
    prefixes AS (
        SELECT d, substr(bits, 1, d) AS shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS n
        FROM rows_, range(0, 61) AS t(d) GROUP BY ALL),
    leaves AS (
        SELECT r.doc_id, r.bytes, r.bits, min(p.d) AS depth
        FROM rows_ r JOIN prefixes p ON starts_with(r.bits, p.shard) AND length(p.shard) = p.d
        WHERE p.shard_bytes <= 1048576 OR p.n = 1 GROUP BY ALL)
    SELECT l.doc_id, l.bytes, p.shard, CAST(l.depth AS INTEGER) AS depth, p.shard_bytes
    FROM leaves l JOIN prefixes p ON p.d = l.depth AND p.shard = substr(l.bits, 1, l.depth)"""

#: The remainders of a byte under the reflected polynomial of crc32, and crc32 itself.
_CRC32 = """
    steps AS (
        SELECT range AS b, range AS c, 0 AS k FROM range(0, 256)
        UNION ALL
        SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    remainders AS MATERIALIZED (SELECT list(c ORDER BY b) AS table_ FROM steps WHERE k = 8)"""


def _crc32(blob: str) -> str:
    """crc32 of a blob expression, where ``remainders`` is in the FROM clause."""
    codes = f"list_transform(range(0, octet_length({blob})), lambda i: CAST('0x' || substr(hex({blob}), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), "
            "lambda c, b: xor(c >> 8, table_[CAST(xor(c, b) & 255 AS INTEGER) + 1])))")


LINE_DEDUP = """
    WITH pieces AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (
        SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM pieces),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    repeated AS (
        SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    decided AS (
        SELECT k.doc_id, k.line, k.line_no, r.keep IS NOT NULL AND r.keep <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
    FROM decided GROUP BY doc_id"""

CONVERSATION_TRIE = f"""
    WITH RECURSIVE {_CRC32},
    ordered AS (
        SELECT conv_id, list(md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) ORDER BY turn NULLS FIRST) AS turns,
               list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS sizes
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    drawn AS (
        SELECT *, CAST({_crc32("encode(CAST(conv_id AS VARCHAR))")} % 9 AS BIGINT) AS h FROM ordered, remainders),
    rebuilt AS (
        SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS path,
               coalesce(b.sizes[1:c.h], []) || c.sizes[c.h + 1:] AS sizes
        FROM drawn c LEFT JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 5),
    members AS (
        SELECT conv_id, path, sizes, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
    nodes AS (
        SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[depth]), 0) AS size,
               coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
        FROM members GROUP BY path[1:depth], depth),
    kids AS (
        SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    weighed AS (
        SELECT n.*, coalesce(k.n, 0) AS n_children, (n.n_convs - 1) * n.size AS saved FROM nodes n LEFT JOIN kids k ON k.node = n.node),
    spread AS (
        SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS above FROM weighed),
    subtrees AS (
        SELECT node[1:above] AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
        FROM spread GROUP BY 1)
    SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
    FROM weighed w JOIN subtrees s ON s.node = w.node LEFT JOIN weighed p ON w.depth > 0 AND p.node = w.node[1:w.depth - 1]"""

SPELLING_VARIANTS = f"""
    WITH RECURSIVE {_CRC32},
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    counted AS (
        SELECT run, n, {_crc32("encode(concat(CAST(doc_id AS VARCHAR), ':', run))")} AS h
        FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run), remainders),
    edited AS (
        SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                       ELSE run END AS word FROM counted),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    skips AS (
        SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 2) AS tail
        FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
    links AS (
        SELECT a.word, b.word AS near, b.n FROM skips a JOIN skips b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
        UNION SELECT a.word, w.word, w.n FROM skips a JOIN words w ON w.word = a.head || a.tail
        UNION SELECT w.word, a.word, a.n FROM skips a JOIN words w ON w.word = a.head || a.tail),
    near AS (
        SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM links GROUP BY word),
    linked AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.best_n >= 2 * w.n THEN r.best END AS form,
               CASE WHEN r.best_n >= 2 * w.n THEN r.best_n END AS form_n FROM words w LEFT JOIN near r USING (word)),
    walk AS (
        SELECT word, word AS at FROM linked
        UNION ALL SELECT k.word, l.form FROM walk k JOIN linked l ON l.word = k.at WHERE l.form IS NOT NULL),
    roots AS (
        SELECT k.word, k.at AS root FROM walk k JOIN linked l ON l.word = k.at WHERE l.form IS NULL)
    SELECT l.word, l.form, r.root, l.n, l.n_near, l.form_n FROM linked l JOIN roots r USING (word)"""
