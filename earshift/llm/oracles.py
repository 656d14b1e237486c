"""DuckDB SQL for the queries that SQL can express."""

from .chat import END, ESCAPES
from .mixing import BITS, BLOCK_WORDS, GOLDEN
from .rules import RULES, STOP_WORDS, SYMBOLS

SPACE = r"[\x20\x09-\x0D]"
TEXT = "coalesce(text, '')"
LOWER = f"translate({TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(string_split_regex({TEXT}, '{SPACE}+'), lambda x: x <> '')"


def _rules() -> str:
    bad = []
    for r in RULES:
        x = f"{r.measure}::DOUBLE / nullif({r.per}, 0)" if r.per else f"{r.measure}::DOUBLE"
        out = [f"({x}) {op} {b}" for op, b in (("<", r.low), (">", r.high)) if b is not None]
        bad.append(f"(coalesce({' OR '.join(out)}, true) AND n_words >= {r.words})")
    return " OR ".join(bad)


_stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
RULES_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, {TEXT} AS t, {WORDS} AS w,
         list_filter(string_split({TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
e AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
f AS (SELECT id, pos, lead(pos, 4) OVER o IS NOT NULL AS five,
             concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win
      FROM e WINDOW o AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT id, pos, count(*) OVER (PARTITION BY id, win) AS c FROM f WHERE five),
r AS (SELECT id, count(DISTINCT pos + k) AS n FROM g, range(5) AS s(k) WHERE c > 1 GROUP BY id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclamations,
             len(list_filter(w, lambda x: x IN ({_stop}))) AS n_stop_words
      FROM d LEFT JOIN r USING (id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR {_rules()}) AS kept FROM b
"""

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1, 2][(rnk % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS lvl, sum(cap) OVER u - cap AS full_, sum(w) OVER () - sum(w) OVER u + w AS open_w,
             sum(source_size) OVER () * 1.5::DOUBLE AS total
      FROM w WINDOW u AS (ORDER BY cap / w, rnk ROWS UNBOUNDED PRECEDING)),
z AS (SELECT arg_min((total - full_) / open_w, (lvl, rnk)) AS lv FROM l WHERE full_ + lvl * open_w >= total),
t AS (SELECT source, source_size, least(cap, lv * w) AS target, floor(least(cap, lv * w) + 0.5)::BIGINT AS goal FROM l, z),
p AS (SELECT d.*, source_size, target, goal,
             (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT rnk, ceil(goal / {BLOCK_WORDS})::BIGINT AS blocks, sum(ceil(goal / {BLOCK_WORDS})) OVER (ORDER BY rnk)::BIGINT AS upto,
             sum(ceil(goal / {BLOCK_WORDS})) OVER ()::BIGINT AS n
      FROM (SELECT rnk, floor(least(cap, lv * w) + 0.5)::BIGINT AS goal FROM l, z) WHERE goal > 0),
e AS (SELECT rnk, blocks, floor((upto - blocks)::DOUBLE / n * {2.0 ** BITS!r}::DOUBLE) AS lo, floor(upto::DOUBLE / n * {2.0 ** BITS!r}::DOUBLE) AS hi FROM b),
g AS (SELECT slot, ((slot::HUGEINT * {GOLDEN}) % {2 ** BITS})::BIGINT AS u
      FROM (SELECT unnest(range(coalesce((SELECT 3 * max(n) FROM b), 0))) AS slot)),
k AS (SELECT rnk, slot, row_number() OVER (PARTITION BY rnk ORDER BY slot) - 1 AS k, blocks
      FROM g JOIN e ON u >= lo::BIGINT AND u < hi::BIGINT),
c AS (SELECT *, row_number() OVER () AS id FROM p),
y AS (SELECT id, rnk, x.at AS lo, least(x.at + size, goal) AS hi FROM (
      SELECT id, rnk, size, goal, unnest([a, a + c.source_size]) AS at FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source) x
      WHERE size > 0 AND x.at < goal),
v AS (SELECT id, rnk, unnest(range(lo // {BLOCK_WORDS}, (hi - 1) // {BLOCK_WORDS} + 1)) AS k FROM y),
f AS (SELECT id, min(slot) AS first_slot, count(*) AS n_slots FROM v JOIN k USING (rnk, k) WHERE k.k < k.blocks GROUP BY id)
SELECT doc_id, size, source_size, target, first_slot, coalesce(n_slots, 0) AS n_slots,
       (greatest(0, least(a + size, goal) - a) + greatest(0, least(a + source_size + size, goal) - a - source_size))::BIGINT AS taken
FROM c LEFT JOIN f USING (id)
"""


def _escape(x: str) -> str:
    for plain, coded in ESCAPES:
        x = f"replace({x}, '{plain}', '{coded}')"
    return x


_end = END.replace("\n", "")
CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) AS s(i))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn:' || {_escape("r")} || '>' || chr(10) || {_escape("t")} || '{_end}' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES = {"op1_quality_rules": RULES_SQL, "op3_exact_dedup": EXACT_SQL, "op9_source_mix": MIX_SQL, "op10_chat_format": CHAT_SQL}


NEAR_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex({LOWER}, '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT id, doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END AS list FROM d),
b AS (SELECT id, shingle, count(*) AS c FROM (SELECT id, unnest(list) AS shingle FROM s) GROUP BY ALL),
n AS (SELECT id, sum(c) AS n FROM b GROUP BY id),
p AS (SELECT x.id AS i, y.id AS k, sum(least(x.c, y.c)) AS both_ FROM b x JOIN b y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL),
l AS (SELECT i, k FROM p JOIN n x ON x.id = i JOIN n y ON y.id = k WHERE both_ / (x.n + y.n - both_) >= 0.8),
e AS (SELECT i, k FROM l UNION ALL SELECT k, i FROM l),
r(id, root) AS (SELECT id, id FROM d UNION SELECT e.k, r.root FROM r JOIN e ON e.i = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
g AS (SELECT root, max(doc_id) AS class_id, count(*) AS class_size FROM c JOIN d USING (id) GROUP BY root)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM d JOIN c USING (id) JOIN g USING (root)
"""


def _urls() -> str:
    from .urls import BIN, BINS, MICRO, ORDER, PAD, PARTS, SIGNS
    from .urls import RULES as url_rules

    rule = says = "NULL"
    for text, verdict in sorted(url_rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')"
        rule, says = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    names = [f"{c}_{f}" for c, f in PARTS]
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cond = {f"{c}_{f}": f"verdict = '{'allow' if c == 'a' else 'block'}'" + ("" if f == "all" else f" AND fold <> {f[-1]}") for c, f in PARTS}
    ctes = [f"p AS (SELECT gram, {', '.join(f'{1.0 / SIGNS!r}::DOUBLE AS p_{x}' for x in names)} FROM g)"]
    last = "p"
    for k in range(ORDER + 1):
        tail = f"substr(gram, {ORDER + 1 - k}, {k + 1})"
        ctes.append(f"n{k} AS (SELECT {tail} AS gg, {', '.join(f'sum({x}) AS n_{x}' for x in names)} FROM g GROUP BY 1)")
        ctes.append(f"c{k} AS (SELECT substr(gg, 1, {k}) AS cc, {', '.join(f'sum(n_{x}) AS s_{x}, count(*) FILTER (n_{x} > 0) AS t_{x}' for x in names)} FROM n{k} GROUP BY 1)")
        blend = ", ".join(f"CASE WHEN s_{x} + t_{x} > 0 THEN (n_{x}::DOUBLE + t_{x} * p_{x}) / (s_{x} + t_{x})::DOUBLE ELSE p_{x} END AS p_{x}" for x in names)
        ctes.append(f"p{k} AS (SELECT gram, {blend} FROM {last} JOIN n{k} ON {tail} = gg JOIN c{k} ON substr(gg, 1, {k}) = cc)")
        last = f"p{k}"
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, coalesce({low.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
             '{PAD * ORDER}' || regexp_replace(regexp_replace({low.format("coalesce(CASE WHEN instr(url, '://') > 0 THEN rest ELSE url END, '')")},
               '[0-9]', '0', 'g'), '[^a-z0./\\-_?]', '~', 'g') AS signs,
             ascii(substr(md5(coalesce(url, '')), 1, 1)) % 2 AS fold FROM a),
u AS (SELECT url, host, path, signs, fold, count(*) AS weight, {rule} AS rule, {says} AS verdict FROM b GROUP BY ALL),
s AS (SELECT url, fold, weight, verdict, substr(signs, pos::INT, {ORDER + 1}) AS gram
      FROM (SELECT *, unnest(range(1, length(signs) - {ORDER} + 1)) AS pos FROM u)),
g AS (SELECT gram, {', '.join(f'coalesce(sum(weight) FILTER ({cond[x]}), 0) AS {x}' for x in names)} FROM s GROUP BY gram),
{', '.join(ctes)},
m AS (SELECT gram, {', '.join(f'round((ln(p_a_{f}) - ln(p_r_{f})) * {MICRO})::BIGINT AS llr_{f}' for f in ("all", "not0", "not1"))} FROM {last}),
t AS (SELECT url, sum(llr_all) AS llr, sum(CASE WHEN fold = 0 THEN llr_not0 ELSE llr_not1 END) AS held, count(*) AS n FROM s JOIN m USING (gram) GROUP BY url),
f AS (SELECT u.*, coalesce(floor(llr::DOUBLE / n / {BIN}), 0) AS bin, coalesce(floor(held::DOUBLE / n / {BIN}), 0) AS held_bin
      FROM u LEFT JOIN t ON u.url IS NOT DISTINCT FROM t.url),
h AS (SELECT greatest(-{BINS}, least({BINS}, held_bin)) AS bin, coalesce(sum(weight) FILTER (verdict = 'allow'), 0) AS a,
             coalesce(sum(weight) FILTER (verdict = 'block'), 0) AS r FROM f WHERE verdict IS NOT NULL GROUP BY 1),
w AS (SELECT bin, sum(a) OVER () - coalesce(sum(a) OVER o, 0) AS kept, coalesce(sum(r) OVER o, 0) AS gone, sum(a) OVER () AS na, sum(r) OVER () AS nr
      FROM h WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT arg_max(bin, (kept * nr + gone * na, -bin)) AS cut FROM w WHERE na > 0 AND nr > 0)
SELECT page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE WHEN bin >= coalesce(cut, -{BINS + 1}) THEN 'allow' ELSE 'block' END) AS verdict
FROM b JOIN f ON b.url IS NOT DISTINCT FROM f.url, z
"""


ORACLES |= {"op4_bag_minhash": NEAR_SQL, "op5_url_model": _urls()}
