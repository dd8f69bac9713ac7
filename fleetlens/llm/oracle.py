"""The results of the registered queries in DuckDB SQL, where SQL can express them.

SQL has no byte-pair encoding, zstandard, checksum of a text or trained classifier; those
queries are tested against brute force instead. License passages are found without MinHash there.
"""

from __future__ import annotations

from fleetlens.llm import license_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    "'[^\\x20\\x09-\\x0D]+')"
)

# The control strings that a chat text may not hold unbroken, as in the template.
ANGLED = r"<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)"
SQUARE = r"\[\\*/?INST\]"

CHAT = f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               count(*) OVER (PARTITION BY conv_id) AS n,
               length('<|im_start|>') + length(role) + 1 + length(text)
               + len(regexp_extract_all(text, '{ANGLED}')) + len(regexp_extract_all(text, '{SQUARE}'))
               + length('<|im_end|>') + 1 AS n_chars
        FROM turns),
    summed AS (
        SELECT *, sum(n_chars) OVER (PARTITION BY conv_id ORDER BY i) AS n_prefix FROM placed),
    read AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
               coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
               CAST(sum(n_prefix) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
           sha256(loss) AS loss_sha256, formatted_chars
    FROM read"""

LEAKS = f"""
    WITH item_words AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    doc_words AS (SELECT doc_id, {WORDS} AS w FROM documents),
    item_at AS (
        SELECT item_id, len(w) - 4 AS n, i - 1 AS pos, w[i:i + 4] AS s
        FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM item_words)),
    doc_at AS (
        SELECT doc_id, i - 1 AS pos, w[i:i + 4] AS s
        FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM doc_words)),
    starts AS (
        SELECT DISTINCT doc_id, item_id, n, d.pos - m.pos AS start
        FROM doc_at d JOIN item_at m USING (s) WHERE d.pos >= m.pos),
    in_window AS (
        SELECT doc_id, item_id, n, start, s, count(*) AS n_here
        FROM starts JOIN doc_at USING (doc_id) WHERE pos BETWEEN start AND start + n - 1
        GROUP BY ALL),
    full_windows AS (
        SELECT doc_id, item_id, n, start FROM in_window
        GROUP BY ALL HAVING sum(n_here) = n),
    in_item AS (SELECT item_id, s, count(*) AS n_item FROM item_at GROUP BY ALL),
    shared AS (
        SELECT doc_id, item_id, n, start, sum(least(n_here, n_item)) AS shared
        FROM in_window JOIN in_item USING (item_id, s)
        SEMI JOIN full_windows USING (doc_id, item_id, n, start)
        GROUP BY ALL)
    SELECT doc_id, item_id, count(*) AS n_windows,
           CAST(max(CAST(shared AS DOUBLE) / CAST(2 * n - shared AS DOUBLE)) AS DOUBLE) AS similarity
    FROM shared WHERE 100 * shared >= 80 * (2 * n - shared) GROUP BY doc_id, item_id"""

NEAR_DUPLICATES = f"""
    WITH RECURSIVE doc_words AS (SELECT doc_id, {WORDS} AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, w[i:i + 1] AS s
        FROM (SELECT *, unnest(range(1, greatest(2, len(w)))) AS i FROM doc_words WHERE len(w) > 0)),
    sizes AS (
        SELECT doc_id, count(s) AS n_shingles
        FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared
        JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
        WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
    components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
    FROM sizes JOIN components USING (doc_id)"""


# CRC-32 of a decimal id: each byte goes in, then eight shifts, which -1 stands for.
CRC = """
    list_reduce(
        [4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
                                 FOR c IN string_split({text}, '')]),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x)
                       ELSE xor(s >> 1, 3988292384 * (s & 1)) END)"""


def crc32(text: str) -> str:
    return f"xor({CRC.format(text=text)}, 4294967295)"


RUNS = f"""
    WITH split AS (
        SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} AS h,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    cut AS (
        SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a,
               h // 10 AS g
        FROM split),
    words AS (
        SELECT doc_id, list_transform(range(len(w)), lambda i: CASE
                   WHEN i < a THEN w[i + 1]
                   ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) AS w
        FROM cut),
    word_at AS (
        SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
    matches AS (
        SELECT x.doc_id, x.i, x.i - y.i AS lag
        FROM word_at x JOIN word_at y
          ON x.doc_id = y.doc_id AND x.word = y.word AND x.i > y.i AND 4 * (x.i - y.i) <= x.n),
    diagonals AS (
        SELECT doc_id, lag, i,
               i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island
        FROM matches),
    stretches AS (
        SELECT doc_id, lag AS period, min(i) - lag AS start, max(i) + 1 AS stop
        FROM diagonals GROUP BY doc_id, lag, island
        HAVING max(i) + 1 - min(i) + lag >= greatest(6, 4 * lag)),
    runs AS (
        SELECT doc_id, start, stop - start AS length, min(period) AS period
        FROM stretches GROUP BY doc_id, start, stop),
    listed AS (
        SELECT doc_id, count(*) AS n_runs,
               first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
        FROM runs GROUP BY doc_id),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
        FROM word_at ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length,
           best.period AS period, 1000 * best.length // best.period AS exponent_milli,
           sha256(coalesce(listed, '')) AS runs_sha256,
           sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


# Levels of a tree that the SQL goes through; more than the test tables need.
TREE_LEVELS = 5


def _told(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    values = [f"CAST({name} AS VARCHAR)" for name in ("doc_id", "source", "lang", "n_chars")]
    return f"sha256({' || '.join(map(_told, [*values, text]))})"


def _levels(name: str) -> str:
    """``name0`` (tree, pos, n, d) and the levels above, each with the children of its nodes."""
    return "".join(
        f"""
    {name}{i + 1} AS (
        SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n,
               CASE WHEN n > 1 THEN list(d ORDER BY pos) END AS kids,
               CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d
        FROM {name}{i} GROUP BY tree, pos // 16, n),"""
        for i in range(TREE_LEVELS)
    )


def _climb(walk: str, first: str, name: str) -> str:
    """Go up the levels with each row of ``first`` (id, tree, pos, d, proof)."""
    found = f"\n    {walk}0 AS ({first}),"
    for i in range(TREE_LEVELS):
        others = "kids[:w.pos % 16] || {} || kids[w.pos % 16 + 2:]"
        found += f"""
    {walk}{i + 1} AS (
        SELECT w.id, w.tree, w.pos // 16 AS pos,
               CASE WHEN kids IS NULL THEN w.d
                    ELSE sha256(array_to_string({others.format('[w.d]')}, '')) END AS d,
               CASE WHEN kids IS NULL THEN proof
                    ELSE proof || array_to_string({others.format('[]')}, '') END AS proof
        FROM {walk}{i} w JOIN {name}{i + 1} u ON u.tree = w.tree AND u.pos = w.pos // 16),"""
    return found


MERKLE = f"""
    WITH leaves AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce('+' || source, '') AS tree,
               {_leaf('text')} AS leaf,
               CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
                    THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
        FROM documents),
    leaf0 AS (
        SELECT id, tree, leaf AS d, count(*) OVER (PARTITION BY tree) AS n,
               row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM leaves),{_levels('leaf')}
    top0 AS (
        SELECT '' AS tree, tree AS of, d, count(*) OVER () AS n,
               row_number() OVER (ORDER BY encode(tree)) - 1 AS pos
        FROM leaf{TREE_LEVELS}),{_levels('top')}
    {_climb('up', "SELECT id, tree, pos, coalesce(changed, leaf) AS d, '' AS proof FROM leaf0 JOIN leaves USING (id, tree)", 'leaf').strip()}
    {_climb('on_', f"SELECT u.id, t.tree, t.pos, u.d, u.proof FROM up{TREE_LEVELS} u JOIN top0 t ON t.of = u.tree", 'top').strip()}
    ended AS (SELECT id, d AS folded_root, sha256(proof) AS proof_sha256 FROM on_{TREE_LEVELS})
    SELECT doc_id, leaf, s.d AS subroot, r.d AS root, proof_sha256, folded_root,
           folded_root = r.d AS verified
    FROM leaves JOIN ended USING (id) JOIN leaf{TREE_LEVELS} s ON s.tree = leaves.tree
    CROSS JOIN top{TREE_LEVELS} r"""


REPEATS = """
    WITH texts AS (
        SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS bytes
        FROM documents),
    windows AS (
        SELECT id, pos, md5(substring(bytes, 2 * pos + 1, 800)) AS window_md5
        FROM (SELECT id, bytes, unnest(range(len(bytes) // 2 - 399)) AS pos FROM texts)),
    repeated AS (
        SELECT id, pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY window_md5) AS n FROM windows)
        WHERE n > 1),
    steps AS (
        SELECT id, pos, coalesce(pos > 400 + lag(pos) OVER (PARTITION BY id ORDER BY pos), true) AS is_new
        FROM repeated),
    spans AS (
        SELECT id, min(pos) AS a, max(pos) + 400 AS b
        FROM (SELECT id, pos, sum(is_new::INT) OVER (PARTITION BY id ORDER BY pos) AS span FROM steps)
        GROUP BY id, span),
    gaps AS (
        SELECT id, b AS a, coalesce(lead(a) OVER (PARTITION BY id ORDER BY a, b), len(bytes) // 2) AS b, bytes
        FROM (SELECT id, a, b FROM spans UNION ALL SELECT id, 0, 0 FROM texts) JOIN texts USING (id)),
    kept AS (
        SELECT id, count(*) - 1 AS n_spans,
               string_agg(substring(bytes, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept
        FROM gaps GROUP BY id)
    SELECT doc_id, len(bytes) // 2 AS n_bytes, len(bytes) // 2 - len(kept) // 2 AS n_removed,
           n_spans, sha256(unhex(kept)) AS kept_sha256
    FROM texts JOIN kept USING (id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    """Exact containment around every window that shares a shingle with a template; the best of rivals."""
    rules = license_scan.LicenseRules()
    related = license_scan.families(license_scan.TEMPLATES, rules)
    rows = ", ".join(
        f"({i}, {_quoted(name)}, {related[i][0]}, {related[i][1]}, {_quoted(text)})"
        for i, (name, text) in enumerate(license_scan.TEMPLATES)
    )
    found = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    shingles = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    reach = rules.window + rules.stride
    return f"""
    WITH given(template, license, family, depth, text) AS (VALUES {rows}),
    templates AS (
        SELECT template, license, family, depth, {shingles} AS s
        FROM (SELECT *, {found} AS w FROM given) WHERE len(w) > 2),
    known AS (SELECT DISTINCT template, len(s) AS size, unnest(s) AS shingle FROM templates),
    totals AS (SELECT template, count(*) AS total FROM known GROUP BY template),
    places AS (
        SELECT doc_id, unnest(s) AS shingle, unnest(range(len(s))) AS place
        FROM (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {found} AS w FROM documents))),
    hits AS (SELECT doc_id, template, size, shingle, place FROM places JOIN known USING (shingle)),
    starts AS (
        SELECT DISTINCT doc_id, template, size, start
        FROM (SELECT *, unnest(range(greatest(0, (place - {rules.window} + {rules.stride}) // {rules.stride})
                                     * {rules.stride}, place + 1, {rules.stride})) AS start FROM hits)),
    shared AS (
        SELECT s.doc_id, s.template, s.start, count(DISTINCT h.shingle) AS shared
        FROM starts s JOIN hits h
          ON h.doc_id = s.doc_id AND h.template = s.template
             AND h.place >= greatest(0, s.start - s.size)
             AND h.place < greatest(0, s.start - s.size) + 2 * s.size + {rules.window}
        GROUP BY ALL),
    checked AS (
        SELECT doc_id, license, family, depth, start, CAST(shared AS DOUBLE) / CAST(total AS DOUBLE) AS share
        FROM shared JOIN totals USING (template) JOIN templates USING (template)
        WHERE 100 * shared >= {rules.min_percent} * total)
    SELECT doc_id, license, max(share) AS containment
    FROM checked c
    WHERE NOT EXISTS (
        SELECT 1 FROM checked b
        WHERE b.doc_id = c.doc_id AND b.family = c.family AND abs(b.start - c.start) <= {reach}
          AND (b.share > c.share OR b.share = c.share AND b.depth > c.depth))
    GROUP BY doc_id, license"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": CHAT,
        "op5_license_scan": _licenses(),
        "op8_decontamination": LEAKS,
        "op9_near_duplicates": NEAR_DUPLICATES,
        "op11_merkle_manifest": MERKLE,
        "op12_repeated_strings": REPEATS,
        "op13_periodic_runs": RUNS,
    }
