"""SQL for every query that SQL can express, for DuckDB on the same tables.

Written from the definitions, independently of the Spark plans: n-gram overlap
by counting in lists, subsequences by a dynamic programme in a recursive CTE.
"""

from __future__ import annotations

import math

from textpair.catalog.stem_sql import stems

# White space as the reference language knows it, and where a
# sentence ends; written out here so that a slip in the library shows.
WHITESPACE = '\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'
SPACE = '[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]'
WORD = '[^\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+'
SENTENCE_END = '([.!?])[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+'

MODELS = ["lead", "mid", "tail"]
LISTED = "'a', 'la', 'le'"
SCORES = ["rouge1", "rouge2", "rougeL", "rougeLsum"]
BLANK = "\n\n"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda t: t <> '')"


def sentences(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{SENTENCE_END}', '\\1\n', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def join_list(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def bigrams(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: concat_ws(' ', {x}[i], {x}[i + 1]))"


def overlap(p: str, r: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({p}), lambda g: "
        f"least(len(list_filter({p}, lambda x: x = g)), len(list_filter({r}, lambda y: y = g))))), 0)"
    )


def f_measure(o: str, np: str, nr: str) -> str:
    p, r = precision(o, np), precision(o, nr)
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::double END"


def precision(o: str, n: str) -> str:
    return f"(({o})::double / greatest({n}, 1))"


TITLE = f"^(?:{SPACE}*{WORD}){{0,8}}"

PRODUCTS = f"""
titled AS (
  SELECT doc_id AS product_id,
    {join_list(f"list_slice({words(f'''regexp_extract(text, '{TITLE}', 0)''')}, 1, 8)")} AS title,
    nullif({strip(f"regexp_replace(text, '{TITLE}', '')")}, '') AS description,
    CASE WHEN source = 'src9' THEN 'test' ELSE 'train' END AS split, lang
  FROM documents),
products AS (
  SELECT product_id, title, description,
    lower({join_list(f"list_slice({words('title')}, 3, 6)")}) AS short_query, split, lang
  FROM titled)"""

TRAIN_INPUT = strip(f"concat_ws('{BLANK}', nullif(title, ''), nullif(description, ''))")
EVAL_INPUT = f"concat_ws('{BLANK}', coalesce(title, 'None'), coalesce(description, 'None'))"



def generated(source: str, text: str) -> str:
    """CTE ``gen``: every row of ``source`` with the output of each generator."""
    return f"""
worded AS (SELECT *, {text} AS input_text, {words(text)} AS w FROM {source}),
gen AS (
  SELECT * EXCLUDE (w), 0 AS model_ord, 'org/lead' AS model_path, 'lead' AS model,
    {join_list("w[1:2 + len(w) % 6]")} AS generated_output FROM worded
  UNION ALL
  SELECT * EXCLUDE (w), 1, 'org/mid', 'mid', {join_list("w[4:4 + len(w) % 5]")} FROM worded
  UNION ALL
  SELECT * EXCLUDE (w), 2, 'org/tail', 'tail', {join_list("w[greatest(len(w) - 3, 1):len(w)]")} FROM worded)"""


GEN = f"{PRODUCTS}, {generated('products', EVAL_INPUT)}"


def lcs_table(name: str, lines: str) -> str:
    """Rows of the subsequence table for every (id, ri, ci) of ``lines``."""
    return f"""
{name}(id, ri, ci, i, cells) AS (
  SELECT id, ri, ci, 0::bigint, list_transform(range(0, len(c) + 1), lambda j: 0::bigint) FROM {lines}
  UNION ALL
  SELECT d.id, d.ri, d.ci, d.i + 1,
    list_transform(range(0, len(l.c) + 1), lambda j: d.cells[j + 1] + CASE WHEN
      len(list_filter(range(1, j + 1), lambda k: l.c[k] = l.r[d.i + 1] AND d.cells[k] = d.cells[j + 1])) > 0
      THEN 1 ELSE 0 END)
  FROM {name} d JOIN {lines} l USING (id, ri, ci) WHERE d.i < len(l.r))"""


def scored(pairs: str, prefix: str = "s", whole: bool = True, summary: bool = True) -> str:
    """CTEs ``{prefix}_f(id, np, nr, f1, f2, lcs, union_lcs)`` for ``pairs(id, pred, ref)``.

    Distinct pairs are scored once; ``id`` numbers them.
    """
    ctes = [f"""
{prefix}_d AS (SELECT row_number() OVER () AS id, pred, ref FROM (SELECT DISTINCT pred, ref FROM {pairs})),
{prefix}_t AS (SELECT id, {tokens('pred')} AS c, {tokens('ref')} AS r, 0::bigint AS ri, 0::bigint AS ci FROM {prefix}_d)"""]
    if whole:
        ctes.append(lcs_table(f"{prefix}_w", f"{prefix}_t"))
        ctes.append(f"""
{prefix}_l AS (SELECT w.id, list_last(w.cells) AS lcs FROM {prefix}_w w JOIN {prefix}_t t ON w.id = t.id AND w.i = len(t.r))""")
    if summary:
        ctes.append(f"""
{prefix}_pl AS (SELECT * FROM (SELECT id, ci, {tokens('line')} AS c FROM (
  SELECT id, unnest(string_split(pred, chr(10))) AS line, generate_subscripts(string_split(pred, chr(10)), 1) AS ci FROM {prefix}_d)) WHERE len(c) > 0),
{prefix}_rl AS (SELECT * FROM (SELECT id, ri, {tokens('line')} AS r FROM (
  SELECT id, unnest(string_split(ref, chr(10))) AS line, generate_subscripts(string_split(ref, chr(10)), 1) AS ri FROM {prefix}_d)) WHERE len(r) > 0),
{prefix}_ll AS (SELECT id, ri, ci, r, c FROM {prefix}_rl JOIN {prefix}_pl USING (id))""")
        ctes.append(lcs_table(f"{prefix}_dp", f"{prefix}_ll"))
        ctes.append(f"""
{prefix}_tab AS (SELECT id, ri, ci, list(cells ORDER BY i) AS tab FROM {prefix}_dp GROUP BY id, ri, ci),
{prefix}_line AS (SELECT * FROM {prefix}_ll JOIN {prefix}_tab USING (id, ri, ci)),
{prefix}_walk(id, ri, ci, i, j, pos) AS (
  SELECT id, ri, ci, len(r)::bigint, len(c)::bigint, NULL::bigint FROM {prefix}_line
  UNION ALL
  SELECT w.id, w.ri, w.ci,
    CASE WHEN l.r[w.i] = l.c[w.j] THEN w.i - 1 WHEN l.tab[w.i + 1][w.j] > l.tab[w.i][w.j + 1] THEN w.i ELSE w.i - 1 END,
    CASE WHEN l.r[w.i] = l.c[w.j] THEN w.j - 1 WHEN l.tab[w.i + 1][w.j] > l.tab[w.i][w.j + 1] THEN w.j - 1 ELSE w.j END,
    CASE WHEN l.r[w.i] = l.c[w.j] THEN w.i END
  FROM {prefix}_walk w JOIN {prefix}_line l USING (id, ri, ci) WHERE w.i > 0 AND w.j > 0),
{prefix}_hit AS (SELECT DISTINCT id, ri, pos FROM {prefix}_walk WHERE pos IS NOT NULL),
{prefix}_u AS (SELECT id, r.r[pos] AS tok, count(*) AS n FROM {prefix}_hit JOIN {prefix}_rl r USING (id, ri) GROUP BY ALL),
{prefix}_c AS (SELECT id, tok, count(*) AS n FROM (SELECT id, unnest(c) AS tok FROM {prefix}_t) GROUP BY ALL),
{prefix}_s AS (SELECT u.id, sum(least(u.n, c.n)) AS hits FROM {prefix}_u u JOIN {prefix}_c c USING (id, tok) GROUP BY u.id)""")
    lcs = "coalesce(l.lcs, 0)" if whole else "0"
    hits = "coalesce(s.hits, 0)" if summary else "0"
    ctes.append(f"""
{prefix}_n AS (
  SELECT t.id, d.pred, d.ref, len(t.c) AS np, len(t.r) AS nr,
    {overlap('t.c', 't.r')} AS o1, {overlap('t.cb', 't.rb')} AS o2, {lcs} AS lcs, {hits} AS uni
  FROM (SELECT *, {bigrams('c')} AS cb, {bigrams('r')} AS rb FROM {prefix}_t) t JOIN {prefix}_d d USING (id)
  {f"LEFT JOIN {prefix}_l l USING (id)" if whole else ""}
  {f"LEFT JOIN {prefix}_s s USING (id)" if summary else ""}),
{prefix}_f AS (
  SELECT *, {f_measure('o1', 'np', 'nr')} AS f1, {f_measure('o2', 'np - 1', 'nr - 1')} AS f2,
    {f_measure('lcs', 'np', 'nr')} AS fl, {f_measure('uni', 'np', 'nr')} AS fs
  FROM {prefix}_n)""")
    return ",".join(ctes)


def pct(f: str) -> str:
    return f"round_even({f} * 100, 2)"


SCORED_GEN = f"""
targeted AS (
  SELECT product_id, title, description, input_text, {sentences('short_query')} AS target_query, model, model_ord,
    generated_output, product_id * 3 + model_ord AS row_ord FROM gen),
respairs AS (SELECT {sentences('generated_output')} AS pred, target_query AS ref FROM targeted),
{scored('respairs')},
results AS (
  SELECT g.*, {pct('s.f1')} AS rouge1, {pct('s.f2')} AS rouge2, {pct('s.fl')} AS "rougeL", {pct('s.fs')} AS "rougeLsum"
  FROM targeted g JOIN s_f s ON s.pred = {sentences('g.generated_output')} AND s.ref = g.target_query)"""
RESULTS = f"WITH RECURSIVE {GEN}, {SCORED_GEN}"
SAMPLE = "SELECT * FROM products ORDER BY md5(concat_ws(':', 42, product_id)), product_id LIMIT 500"
SAMPLED_RESULTS = f"WITH RECURSIVE {PRODUCTS}, sampled AS ({SAMPLE}), {generated('sampled', 'title')}, {SCORED_GEN}"

DIALOG = """
dialog AS (
  SELECT conv_id, turn, pred, ref FROM (
    SELECT conv_id, turn, role, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations)
  WHERE role = 'user' AND ref IS NOT NULL)"""

VEC_PAIRS = """
vecs AS (
  SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

EVAL_COLUMNS = [
    "eval_loss", "eval_rouge1", "eval_rouge2", "eval_rougeL", "eval_rougeLsum", "eval_runtime",
    "eval_samples_per_second", "eval_steps_per_second",
]
VALUE_COLUMNS = ["loss", "grad_norm", "learning_rate", *EVAL_COLUMNS]
_KNOWN = {
    "loss": "CASE WHEN kind = 'train' THEN value END",
    "grad_norm": "CASE WHEN kind = 'train' AND seq % 2 = 0 THEN value / 10 END",
    "learning_rate": "CASE WHEN kind = 'train' THEN 0.001::double END",
    "eval_loss": "CASE WHEN kind = 'eval' THEN value END",
    "eval_rougeL": "CASE WHEN kind = 'eval' THEN (user_id % 101)::double END",
}
LOGS = f"""
kinds AS (
  SELECT event_id AS seq, 'run' || (event_id // 3 % 2) AS run, event_id // 6 AS step, value, user_id,
    CASE WHEN event_id % 50 = 49 THEN 'final' WHEN event_type IN ('click', 'view', 'error') THEN 'train' ELSE 'eval' END AS kind
  FROM events),
logs AS (
  SELECT seq, run, step, step / 100 AS epoch, kind, value, {', '.join(f'{_KNOWN.get(c, "NULL::double")} AS "{c}"' for c in VALUE_COLUMNS)}
  FROM kinds)"""
# At most three records share a key here, so a key emits at most once: at the
# first record that completes it.
MERGED = f"""{LOGS},
firsts AS (
  SELECT run, epoch, step, min(seq) FILTER (kind = 'train') AS ft, min(seq) FILTER (kind = 'eval') AS fe
  FROM logs WHERE kind <> 'final' GROUP BY ALL),
merged AS (
  SELECT l.run, l.epoch, l.step, {', '.join(f'max_by("{c}", seq) FILTER ("{c}" IS NOT NULL) AS "{c}"' for c in VALUE_COLUMNS)}
  FROM logs l JOIN firsts f ON l.run = f.run AND l.epoch = f.epoch AND l.step = f.step
  WHERE kind <> 'final' AND ft IS NOT NULL AND fe IS NOT NULL AND seq <= greatest(ft, fe) GROUP BY l.run, l.epoch, l.step)"""
MERGED_COLUMNS = ", ".join(["run", "epoch", "step", *[f'"{c}"' for c in VALUE_COLUMNS]])
FINAL_COLUMNS = """run, value AS train_runtime, NULL::double AS train_samples_per_second,
  NULL::double AS train_steps_per_second, NULL::double AS train_loss, epoch, step"""


def term_cosine(source: str, key: str, a: str, b: str, name: str) -> str:
    """CTEs ending in ``{name}(key, similarity)`` for the two texts of ``source``."""
    return f"""
{name}_a AS (SELECT {key} AS k, tok, count(*) AS n FROM (SELECT {key}, unnest({tokens(f"coalesce({a}, '')")}) AS tok FROM {source}) GROUP BY ALL),
{name}_b AS (SELECT {key} AS k, tok, count(*) AS n FROM (SELECT {key}, unnest({tokens(f"coalesce({b}, '')")}) AS tok FROM {source}) GROUP BY ALL),
{name}_na AS (SELECT k, sum(n * n) AS s FROM {name}_a GROUP BY k),
{name}_nb AS (SELECT k, sum(n * n) AS s FROM {name}_b GROUP BY k),
{name}_dot AS (SELECT k, sum(x.n * y.n) AS s FROM {name}_a x JOIN {name}_b y USING (k, tok) GROUP BY k),
{name} AS (
  SELECT p.{key} AS k, coalesce(round(d.s::double / (sqrt(x.s::double) * sqrt(y.s::double)), 6), 0.0) AS similarity
  FROM {source} p LEFT JOIN {name}_na x ON x.k = p.{key} LEFT JOIN {name}_nb y ON y.k = p.{key} LEFT JOIN {name}_dot d ON d.k = p.{key})"""


def content(*columns: str) -> str:
    """Checksum of text columns over all rows."""
    texts = ", ".join(f"coalesce({c}, '-')" for c in columns)
    return f"CAST(sum(('0x' || substr(md5(concat_ws('|', {texts})), 1, 8))::bigint) AS bigint)"


def long_scores(where: str, cols=SCORES) -> str:
    return " UNION ALL ".join(
        f"""SELECT model, '{c}' AS metric, "{c}" AS value FROM {where}""" for c in cols
    )


def histogram(long: str, bins: int) -> str:
    return f"""
hl AS ({long}),
hr AS (SELECT model, metric, min(value) - CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS a,
  max(value) + CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS b FROM hl GROUP BY ALL),
hb AS (SELECT model, metric, least(floor((value - a) * {bins} / (b - a)) + 1, {bins})::integer AS bin, count(*) AS n
  FROM hl JOIN hr USING (model, metric) GROUP BY ALL),
hist AS (
  SELECT r.model, r.metric, i::integer AS bin, round(a + (b - a) / {bins} * (i - 1), 6) AS lo,
    round(a + (b - a) / {bins} * i, 6) AS hi, coalesce(n, 0)::bigint AS n
  FROM hr r CROSS JOIN range(1, {bins + 1}) g(i) LEFT JOIN hb ON hb.model = r.model AND hb.metric = r.metric AND hb.bin = i)"""


def density(long: str, reach: float, count_bins: int | None = None) -> str:
    factor = f" * n * (b - a) / {count_bins}" if count_bins else ""
    return f"""
dl AS ({long}),
ds AS (SELECT model, metric, count(*)::double AS n, min(value) AS a, max(value) AS b,
  stddev_samp(value) * pow(count(*), -0.2) AS h FROM dl GROUP BY ALL HAVING max(value) > min(value)),
dc AS (SELECT model, metric, value, count(*) AS c FROM dl GROUP BY ALL),
dg AS (SELECT *, a - h * {reach} + (b - a + 2 * h * {reach}) * i / 199 AS x FROM ds CROSS JOIN range(0, 200) g(i)),
dens AS (
  SELECT model, metric, round(x, 6) AS x,
    round(sum(c * exp(-0.5 * pow((x - value) / h, 2)) / (n * h * {math.sqrt(2 * math.pi)!r}){factor}), 6) AS density
  FROM dg JOIN dc USING (model, metric) GROUP BY model, metric, i, x)"""


PAIR = "(SELECT * FROM results WHERE model IN ('lead', 'mid'))"


def mean(c: str, where: str = "") -> str:
    """Mean of scores with two decimals: hundredths added up exactly, divided once."""
    return f'CAST(sum(CAST(round("{c}" * 100) AS BIGINT)) {where} AS DOUBLE) / (1e2 * count("{c}") {where})'


AVGS = ", ".join(f'{mean(c)} AS "{c}_avg"' for c in SCORES)
BY_SIZE = f"""sized AS (SELECT len({words('generated_output')})::integer AS size, {', '.join(f'{mean(c)} AS "{c}_avg"' for c in SCORES)}
  FROM results WHERE model = 'lead' GROUP BY ALL)"""
SCORE_LIST = ", ".join(f'"{c}"' for c in SCORES)
OUTPERFORMED = " AND ".join(f'a."{c}" > b."{c}"' for c in SCORES)
ZERO = " AND ".join(f'"{c}" = 0' for c in SCORES)
RESULT_COLUMNS = f"title, description, input_text, target_query, model, generated_output, {SCORE_LIST}"

VOCAB_SIZE = 4_000
VOCAB = f"""
vtok AS (SELECT unnest({tokens("concat_ws(' ', title, description, short_query)")}) AS token FROM products),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 2)::integer AS id
  FROM (SELECT token, count(*) AS n FROM vtok GROUP BY token) QUALIFY id < {VOCAB_SIZE}
  UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '</s>', 1 UNION ALL SELECT '<unk>', 2)"""


def encoded(name: str, expr: str, limit: int) -> str:
    return f"""
{name}_t AS (SELECT product_id, unnest(list_slice(t, 1, {limit - 1})) AS token, generate_subscripts(list_slice(t, 1, {limit - 1}), 1) AS pos
  FROM (SELECT product_id, {tokens(expr)} AS t FROM products)),
{name} AS (SELECT p.product_id, coalesce(x.ids, '') || CASE WHEN x.ids IS NULL THEN '1' ELSE ' 1' END AS ids, coalesce(x.n, 0) + 1 AS n, coalesce(x.txt, '') AS txt
  FROM products p LEFT JOIN (
    SELECT t.product_id, string_agg(coalesce(v.id, 2)::varchar, ' ' ORDER BY pos) AS ids, count(*) AS n,
      string_agg(v.token, ' ' ORDER BY pos) AS txt
    FROM {name}_t t LEFT JOIN vocab v ON v.token = t.token GROUP BY t.product_id) x ON x.product_id = p.product_id)"""


def core_word(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}.]+$', ''))"


def base_word(x: str) -> str:
    return f"regexp_replace({x}, '[.]+$', '')"


def period_word(x: str) -> str:
    return f"regexp_matches({x}, '[^.][.]$')"


def abbreviated(x: str, listed: str) -> str:
    """Whether a word stands for an abbreviation or initial with its period."""
    core = core_word(x)
    return f"({period_word(core)} AND ({base_word(core)} IN ({listed}) OR regexp_matches({base_word(core)}, '^\\p{{L}}$')))"


def learned_sentences(abbreviations: str) -> str:
    """CTEs ``ab_all`` (word, n_period, n_plain, score) and ``st_all`` (word, n, n_start, score) over conversations."""
    return f"""
turn_words AS (SELECT conv_id, turn, {words("coalesce(text, '')")} AS w FROM conversations),
ab_words AS (SELECT {core_word('x')} AS x FROM (SELECT unnest(w) AS x FROM turn_words)),
ab_counts AS (SELECT {base_word('x')} AS word, count(*) FILTER ({period_word('x')}) AS n_period, count(*) FILTER (NOT {period_word('x')}) AS n_plain FROM ab_words GROUP BY ALL),
ab_total AS (SELECT sum(n_period)::double AS np, sum(n_period + n_plain)::double AS n FROM ab_counts),
ab_all AS (SELECT word, n_period, n_plain,
    2 * (n_period * ln(0.99 / (np / n)) + n_plain * ln(0.01 / (1 - np / n))) * exp(-letters) * (dots + 1) * pow(letters, -n_plain) AS score
  FROM (SELECT *, length(word) - length(replace(word, '.', '')) AS dots, length(replace(word, '.', '')) AS letters FROM ab_counts), ab_total
  WHERE n_period > 0 AND regexp_matches(word, '^[\\p{{L}}.-]*\\p{{L}}[\\p{{L}}.-]*$')),
st_pairs AS (SELECT unnest(w) AS x, unnest(list_prepend(NULL, w[1:len(w) - 1])) AS before FROM turn_words WHERE len(w) > 0),
st_words AS (SELECT {base_word(core_word('x'))} AS word, coalesce(regexp_matches(before, '[.!?]$') AND NOT {abbreviated('before', abbreviations)}, false) AS starts FROM st_pairs),
st_counts AS (SELECT word, count(*) AS n, count(*) FILTER (starts) AS k FROM st_words WHERE word <> '' GROUP BY word),
st_total AS (SELECT sum(n)::double AS t, sum(k)::double AS a FROM st_counts),
st_cells AS (SELECT word, n, k, unnest([[k, a, n], [a - k, a, t - n], [n - k, t - a, n], [t - a - n + k, t - a, t - n]]) AS c, t
  FROM st_counts, st_total WHERE k > 0 AND regexp_matches(word, '^\\p{{L}}') AND k * t > a * n),
st_all AS (SELECT word, n, k AS n_start, 2 * sum(CASE WHEN c[1] > 0 THEN c[1] * ln(c[1] * t / (c[2] * c[3])) ELSE 0 END) AS score FROM st_cells GROUP BY word, n, k)"""


def learned_lines() -> str:
    """Sentences by what ``ab_all`` and ``st_all`` list."""
    mark, last, following = "chr(57344)", "p.last", "p.following"
    starts = f"regexp_matches({following}, '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}') AND {base_word(core_word(following))} IN (SELECT word FROM st_all WHERE score >= 30)"
    ordinal = f"{period_word(core_word(last))} AND regexp_matches({base_word(core_word(last))}, '^\\p{{N}}+$') AND regexp_matches({following}, '^[^\\p{{L}}\\p{{N}}]*\\p{{Ll}}')"
    unsure = abbreviated(last, "SELECT word FROM ab_all WHERE score >= 0.3")
    return f"""
pieces AS (SELECT conv_id, turn, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
  SELECT conv_id, turn, string_split(regexp_replace({strip('text')}, '([.!?])({SPACE})', '\\1' || {mark} || '\\2', 'g'), {mark}) AS ps FROM conversations)),
p AS (SELECT *, list_last(string_split_regex(lag(piece) OVER (PARTITION BY conv_id, turn ORDER BY i), '{SPACE}+')) AS last,
  regexp_extract(piece, '^{SPACE}+({WORD})', 1) AS following FROM pieces),
cut AS (SELECT conv_id, turn, i, CASE WHEN i = 1 THEN piece
  WHEN regexp_matches(last, '[!?]$') OR CASE WHEN {unsure} THEN {starts} ELSE NOT ({ordinal}) END
  THEN chr(10) || regexp_replace(piece, '^{SPACE}+', '') ELSE piece END AS line FROM p)
SELECT conv_id, turn, string_agg(line, '' ORDER BY i) AS sentences FROM cut GROUP BY conv_id, turn"""


# Fixed value: the published rule that cuts texts into pieces, less its look-ahead.
PIECE = "''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+"


def subword_ctes(sources: dict[str, str]) -> str:
    """``piece_ids`` (piece, ids) of every distinct piece, and a table ``<name>_p`` (product_id, pos, piece) per text.

    A piece of white space leaves its last character to what follows; a mark is set there first, as these regular
    expressions cannot look ahead.  Pairs of lowest rank merge one at a time.
    """
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return "ranks AS (SELECT 1)"
    mark = "chr(57344)"
    texts = ", ".join(
        f"""{name}_s AS (SELECT product_id, generate_subscripts(parts, 1) AS part, unnest(parts) AS body FROM (
  SELECT product_id, string_split(regexp_replace(coalesce({expr}, ''), '(\\s+)(\\s)(\\S)', '\\1' || {mark} || '\\2\\3', 'g'), {mark}) AS parts FROM products)),
{name}_p AS (SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY part, i))::integer AS pos, piece FROM (
  SELECT product_id, part, generate_subscripts(found, 1) AS i, unnest(found) AS piece FROM (
    SELECT product_id, part, regexp_extract_all(body, '{PIECE}') AS found FROM {name}_s)))"""
        for name, expr in sources.items()
    )
    every = " UNION ALL ".join(f"SELECT piece FROM {name}_p" for name in sources)
    return f"""{texts},
ranks AS (SELECT hex(from_base64(column0)) AS token, column1::integer AS id
  FROM read_csv('{public_tokenizers.path("byte_bpe_50k.tiktoken")}', delim = ' ', header = false, quote = '', escape = '', columns = {{'column0': 'VARCHAR', 'column1': 'VARCHAR'}})),
distinct_pieces AS (SELECT DISTINCT piece FROM ({every})),
merges AS (
  SELECT piece, list_transform(range(0, octet_length(encode(piece))), lambda i: substr(hex(encode(piece)), i * 2 + 1, 2)) AS parts FROM distinct_pieces
  UNION ALL
  SELECT piece, list_concat(list_concat(parts[1:i - 1], [parts[i] || parts[i + 1]]), parts[i + 2:]) AS parts FROM (
    SELECT piece, parts, arg_min(i, id * 1000000::bigint + i) AS i
    FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM merges) JOIN ranks ON token = parts[i] || parts[i + 1]
    GROUP BY piece, parts)
),
last_merges AS (SELECT piece, arg_min(parts, len(parts)) AS parts FROM merges GROUP BY piece),
piece_ids AS (
  SELECT piece, list(id ORDER BY k) AS ids
  FROM (SELECT piece, generate_subscripts(parts, 1) AS k, unnest(parts) AS token FROM last_merges) JOIN ranks USING (token) GROUP BY piece)"""


def subwords_of(name: str, limit: int | None = None) -> str:
    """The ids of each text as a list, cut."""
    cut = "" if limit is None else f"[1:{limit}]"
    return f"""(SELECT products.product_id, coalesce(ids, []){cut} AS ids FROM products LEFT JOIN (
  SELECT product_id, flatten(list(ids ORDER BY pos)) AS ids FROM {name}_p JOIN piece_ids USING (piece) GROUP BY product_id) x USING (product_id))"""


def _thresholds() -> list[float]:
    total, out = 0.0, []
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


# One draw per row and resample: a universal hash modulo 2**31 - 1.
WEIGHT = " + ".join(f"(u >= {x!r})::integer" for x in _thresholds())
BOOTSTRAP = f"""
units AS (
  SELECT ('0x' || substr(md5(concat_ws(':', 42, row_ord)), 1, 8))::bigint % 2147483647 AS unit,
    {', '.join(f'"{c}"' for c in SCORES)} FROM results),
functions AS (
  SELECT b, 1 + ('0x' || substr(md5(concat_ws(':', 42, b)), 1, 8))::bigint % 2147483646 AS factor,
    ('0x' || substr(md5(concat_ws(':', 42, b)), 9, 8))::bigint % 2147483647 AS term FROM range(0, 1000) g(b)),
draws AS (SELECT *, ((unit * factor + term) % 2147483647) / 2147483647.0::double AS u FROM units CROSS JOIN functions),
means AS (SELECT b, {', '.join(f'sum(w * "{c}") / sum(w) AS "{c}"' for c in SCORES)}
  FROM (SELECT *, {WEIGHT} AS w FROM draws) GROUP BY b)"""

DIALOG_SENTENCES = f"SELECT {sentences('pred')} AS pred, {sentences('ref')} AS ref FROM dialog"
DIALOG_SCORED = f"""WITH RECURSIVE {DIALOG},
dpairs AS ({DIALOG_SENTENCES}),
{scored('dpairs')}"""
DIALOG_PLAIN = f"""WITH RECURSIVE {DIALOG},
dpairs AS (SELECT pred, ref FROM dialog),
{scored('dpairs', summary=False)}"""


def stemmed_text(column: str, name: str) -> str:
    """CTE ``{name}(conv_id, turn, text)``: the lines of ``column`` as stems."""
    return f"""
{name} AS (
  SELECT conv_id, turn, string_agg(coalesce(line, ''), chr(10) ORDER BY li) AS text FROM (
    SELECT l.conv_id, l.turn, l.li, string_agg(s.stem, ' ' ORDER BY t.ti) AS line FROM (
      SELECT conv_id, turn, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS li
      FROM (SELECT conv_id, turn, {sentences(column)} AS x FROM dialog)) l
    LEFT JOIN (SELECT conv_id, turn, li, unnest(toks) AS token, generate_subscripts(toks, 1) AS ti FROM (
      SELECT conv_id, turn, li, {tokens('line')} AS toks FROM (
        SELECT conv_id, turn, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS li
        FROM (SELECT conv_id, turn, {sentences(column)} AS x FROM dialog)))) t USING (conv_id, turn, li)
    LEFT JOIN stems s USING (token) GROUP BY ALL)
  GROUP BY conv_id, turn)"""


DIALOG_TOKENS = f"""
dtok AS (SELECT DISTINCT token FROM (SELECT unnest({tokens("concat_ws(' ', pred, ref)")}) AS token FROM dialog))"""
CORPUS = ", ".join(f'round_even(avg(s.{f}) * 100, 4) AS "{c}"' for f, c in zip(("f1", "f2", "fl", "fs"), SCORES))
DIALOG_STEMMED = f"""WITH RECURSIVE {DIALOG}, {DIALOG_TOKENS}, {stems('dtok')},
{stemmed_text('pred', 'spred')}, {stemmed_text('ref', 'sref')},
spairs AS (SELECT p.text AS pred, r.text AS ref FROM spred p JOIN sref r USING (conv_id, turn)),
{scored('spairs')}"""


def prf(o: str, np: str = "np", nr: str = "nr") -> str:
    return (
        f"round({precision(o, np)}, 6) AS p, round({precision(o, nr)}, 6) AS r, "
        f"round({f_measure(o, np, nr)}, 6) AS f"
    )


def _lcs_similarity() -> str:
    return f"""simsrc AS (SELECT row_ord, target_query, generated_output FROM results),
{term_cosine('simsrc', 'row_ord', 'target_query', 'generated_output', 'sim')},
simrows AS (SELECT r.*, s.similarity AS semantic_similarity FROM results r JOIN sim s ON s.k = r.row_ord)"""


SIMILAR = _lcs_similarity()

BOTH_LOGS = f"""WITH {MERGED}
SELECT 'merged' AS log, true AS stamped, run, epoch, step, loss, "eval_rougeL", NULL::double AS train_runtime FROM merged
UNION ALL SELECT 'final', true, run, epoch, step, NULL, NULL, value FROM logs WHERE kind = 'final'"""

ORACLES: dict[str, str] = {
    "load_split": f"WITH {PRODUCTS} SELECT product_id, title, description, short_query, lang FROM products WHERE split = 'test'",
    "read_results": f"{RESULTS} SELECT {RESULT_COLUMNS} FROM results",
    "write_results": f"{RESULTS} SELECT {RESULT_COLUMNS} FROM results",
    "write_case_slices": f"""{RESULTS},
o AS (SELECT a.target_query, a.generated_output AS a_output, b.generated_output AS b_output FROM results a JOIN results b ON a.target_query = b.target_query
  WHERE a.model = 'mid' AND b.model = 'lead' AND {OUTPERFORMED})
SELECT 'zeros' AS slice, count(*) AS n, count(DISTINCT target_query) AS targets, {content("target_query", "generated_output")} AS content
  FROM results WHERE model = 'lead' AND {ZERO}
UNION ALL SELECT 'better_mid', count(*), count(DISTINCT target_query), {content("target_query", "a_output", "b_output")} FROM o
UNION ALL SELECT 'best', count(*), count(DISTINCT target_query), {content("target_query", "generated_output")}
  FROM results WHERE model = 'lead' AND "rougeL" >= 50
UNION ALL SELECT 'worst', count(*), count(DISTINCT target_query), {content("target_query", "generated_output")}
  FROM results WHERE model = 'lead' AND "rougeL" <= 0""",
    "write_metric_logs": BOTH_LOGS,
    "split_profile": f"""WITH {PRODUCTS} SELECT split, count(*) AS n_rows, 6 AS n_columns,
greatest(1, count(*) // 32) AS steps_per_epoch FROM products GROUP BY split""",
    "concat_input_train": f"WITH {PRODUCTS} SELECT product_id, {TRAIN_INPUT} AS input_text FROM products",
    "concat_input_eval": f"WITH {PRODUCTS} SELECT product_id, {EVAL_INPUT} AS input_text FROM products",
    "stringify_metadata": f"""WITH {PRODUCTS} SELECT product_id::varchar AS product_id, coalesce(title, 'None') AS title,
coalesce(description, 'None') AS description, '' AS brand FROM products""",
    "drop_source_columns": f"WITH {PRODUCTS} SELECT product_id, {TRAIN_INPUT} AS input_text, short_query AS label FROM products",
    "model_short_name": f"WITH {GEN} SELECT product_id, model_path, list_last(string_split(model_path, '/')) AS short_name FROM gen",
    "model_pair_filter": f"{RESULTS} SELECT product_id, model, {SCORE_LIST} FROM results WHERE model IN ('lead', 'mid')",
    "zero_score_rows": f"{RESULTS} SELECT product_id, target_query, generated_output FROM results WHERE model = 'lead' AND {ZERO}",
    "best_rows": f"""{RESULTS} SELECT product_id, target_query, generated_output, "rougeL" FROM results WHERE model = 'lead' AND "rougeL" >= 50""",
    "worst_rows": f"""{RESULTS} SELECT product_id, target_query, generated_output, "rougeL" FROM results WHERE model = 'lead' AND "rougeL" <= 0""",
    "scores_long": RESULTS + " " + " UNION ALL ".join(
        f"""SELECT product_id, model, '{c}' AS metric, "{c}" AS value FROM results""" for c in SCORES),
    "curate_title_only": f"WITH {PRODUCTS} SELECT product_id, {strip('title')} AS input_text, short_query FROM products",
    "curate_title_description": f"WITH {PRODUCTS} SELECT product_id, {TRAIN_INPUT} AS input_text, short_query FROM products",
    "similarity_filter": f"""WITH {PRODUCTS}, {term_cosine('products', 'product_id', 'title', 'short_query', 'sim')}
SELECT product_id, title, short_query, similarity FROM products JOIN sim ON k = product_id WHERE similarity > 0.7""",
    "language_alignment_filter": f"""WITH {PRODUCTS}, {term_cosine('products', 'product_id', 'description', 'short_query', 'sim')}
SELECT product_id, lang, short_query, similarity FROM products JOIN sim ON k = product_id WHERE lang = 'en' AND similarity >= 0.1""",
    "outperformed_rows": f"""{RESULTS} SELECT a.target_query, a.generated_output AS generated_output_mid, b.generated_output AS generated_output_lead
FROM results a JOIN results b ON a.target_query IS NOT DISTINCT FROM b.target_query WHERE a.model = 'mid' AND b.model = 'lead' AND {OUTPERFORMED}""",
    "outperformed_counts": f"""{RESULTS}, distinct_outputs AS (
  SELECT target_query, generated_output, {SCORE_LIST}, count(*) AS n FROM results WHERE model = 'mid' GROUP BY ALL)
SELECT a.target_query, a.generated_output, a.n, count(*) AS wins
FROM distinct_outputs a JOIN results b ON a.target_query IS NOT DISTINCT FROM b.target_query AND b.model = 'lead' AND {OUTPERFORMED} GROUP BY ALL""",
    "outperformed_rows_by_product": f"""{RESULTS} SELECT a.target_query, a.product_id, a.generated_output AS generated_output_mid, b.generated_output AS generated_output_lead
FROM results a JOIN results b ON a.product_id = b.product_id WHERE a.model = 'mid' AND b.model = 'lead' AND {OUTPERFORMED}""",
    "row_by_model": f"WITH {GEN} SELECT product_id, model_ord, model_path, model, title FROM gen",
    "side_by_side_outputs": f"""{RESULTS} SELECT a.product_id, a.target_query, a.generated_output AS output_1, b.generated_output AS output_2
FROM results a JOIN results b ON a.product_id = b.product_id AND a.model = 'lead' AND b.model = 'mid'""",
    "align_predictions": f"WITH {GEN} SELECT product_id, model, input_text, short_query AS target_query, generated_output FROM gen",
    "avg_scores_by_model": f"{RESULTS} SELECT model, {AVGS} FROM results GROUP BY model",
    "avg_scores_by_size": f"""{RESULTS}, {BY_SIZE} SELECT size, {', '.join(f'"{c}_avg"' for c in SCORES)} FROM sized""",
    "size_score_diff": f"""{RESULTS}, {BY_SIZE} SELECT size, {', '.join(f'"{c}_avg"' for c in SCORES)},
{', '.join(f'coalesce("{c}_avg" - lag("{c}_avg") OVER (ORDER BY size), 0.0) AS "{c}_diff"' for c in SCORES)} FROM sized""",
    "output_length_range": f"""WITH {GEN} SELECT max(n)::integer AS max_words, min(n)::integer AS min_words
FROM (SELECT len({words('generated_output')}) AS n FROM gen WHERE model = 'lead')""",
    "models_in_order": f"WITH {GEN} SELECT model, min(product_id * 3 + model_ord) AS ord FROM gen GROUP BY model",
    "select_model_pair": f"""WITH {GEN} SELECT model, count(*) AS n FROM gen WHERE model IN (
SELECT model FROM (SELECT model, row_number() OVER (ORDER BY min(product_id * 3 + model_ord)) - 1 AS i FROM gen GROUP BY model) WHERE i IN (0, 2))
GROUP BY model""",
    "stem_vocabulary": f"WITH {DIALOG}, {DIALOG_TOKENS}, {stems('dtok')} SELECT token, stem FROM stems",
    "corpus_rouge_stemmed": f"{DIALOG_STEMMED} SELECT {CORPUS} FROM spairs d JOIN s_f s ON s.pred = d.pred AND s.ref = d.ref",
    "corpus_rouge": f"""{DIALOG_SCORED} SELECT {CORPUS}
FROM dpairs d JOIN s_f s ON s.pred = d.pred AND s.ref = d.ref""",
    "corpus_rouge_bootstrap": f"{RESULTS}, {BOOTSTRAP} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, round(quantile_cont("{c}", 0.025), 4) AS low, round(quantile_cont("{c}", 0.5), 4) AS mid,
round(quantile_cont("{c}", 0.975), 4) AS high FROM means""" for c in SCORES),
    "score_histogram": f"{RESULTS}, {histogram(long_scores(PAIR), 20)} SELECT * FROM hist",
    "histogram_overlay": f"{RESULTS}, {density(long_scores(PAIR), 0.0, 20)} SELECT * FROM dens",
    "score_density": f"{RESULTS}, {density(long_scores(PAIR), 3.0)} SELECT * FROM dens",
    "similarity_histogram": f"""WITH {VEC_PAIRS},
{histogram("SELECT 'vectors' AS model, 'semantic_similarity' AS metric, cosine AS value FROM vecs", 25)} SELECT * FROM hist""",
    "similarity_vs_rouge": f"{RESULTS}, {SIMILAR} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, round(corr(semantic_similarity, "{c}"), 6) AS corr FROM simrows WHERE model = 'lead'""" for c in SCORES),
    "similarity_vs_rouge_points": f"{RESULTS}, {SIMILAR} " + " UNION ALL ".join(
        f"""SELECT semantic_similarity AS similarity, '{c}' AS metric, "{c}" AS value FROM simrows WHERE model = 'lead'""" for c in SCORES),
    "model_gap": f"{RESULTS}, g AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, {mean(c, "FILTER (model = 'lead')")} AS a, {mean(c, "FILTER (model = 'mid')")} AS b FROM results""" for c in SCORES)
        + ") SELECT metric, a AS avg1, b AS avg2, a - b AS gap FROM g",
    "metrics_merge": f"WITH {MERGED} SELECT {MERGED_COLUMNS} FROM merged",
    "best_checkpoint": f"""WITH {MERGED} SELECT run, step, epoch, "eval_rougeL" FROM merged WHERE "eval_rougeL" IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY run ORDER BY "eval_rougeL" DESC, step) <= 1""",
    "retained_checkpoints": f"""WITH {MERGED} SELECT run, step, epoch, "eval_rougeL" FROM merged WHERE "eval_rougeL" IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY run ORDER BY "eval_rougeL" DESC, step) <= 3""",
    "seeded_sample": f"WITH {PRODUCTS} SELECT product_id, title, short_query FROM products ORDER BY md5(concat_ws(':', 42, product_id)), product_id LIMIT 500",
    "dev_head": f"""WITH {PRODUCTS} SELECT product_id, split, title FROM products
QUALIFY row_number() OVER (PARTITION BY split ORDER BY product_id) <= 100""",
    "union_expanded": f"""WITH {PRODUCTS} SELECT product_id, 'TD' AS variant, {TRAIN_INPUT} AS input_text, short_query FROM products
UNION ALL SELECT product_id, 'T', {strip('title')}, short_query FROM products""",
    "union_curated": f"""WITH {PRODUCTS}, {term_cosine('products', 'product_id', 'title', 'short_query', 'sim')}
SELECT product_id, 'TD' AS variant, {TRAIN_INPUT} AS input_text, short_query FROM products
UNION ALL SELECT product_id, 'T', {strip('title')}, short_query FROM products JOIN sim ON k = product_id WHERE similarity > 0.7""",
    "combine_splits": f"WITH {PRODUCTS} SELECT product_id, title, split FROM products",
    "sentence_newlines": f"SELECT conv_id, turn, {sentences('text')} AS sentences FROM conversations",
    "strip_text": f"SELECT doc_id, {strip('text')} AS stripped FROM documents",
    "word_count": f"SELECT doc_id, len({words('text')})::integer AS n_words FROM documents",
    "sentence_abbreviations": f"WITH {learned_sentences(LISTED)} SELECT word, n_period, n_plain, round(score, 4) AS score FROM ab_all WHERE score >= 0.3",
    "sentence_starters": f"WITH {learned_sentences(LISTED)} SELECT word, n, n_start, round(score, 4) AS score FROM st_all WHERE score >= 30",
    "sentence_newlines_learned": f"WITH {learned_sentences('SELECT word FROM ab_all WHERE score >= 0.3')}, {learned_lines()}",
    "rouge_tokens": f"""WITH {PRODUCTS} SELECT product_id, {join_list('t')} AS tokens, len(t)::integer AS n_tokens
FROM (SELECT product_id, {tokens("coalesce(description, '')")} AS t FROM products)""",
    "rouge_1": f"{DIALOG_PLAIN} SELECT d.conv_id, d.turn, {prf('o1')} FROM dialog d JOIN s_f s ON s.pred = d.pred AND s.ref = d.ref",
    "rouge_2": f"""WITH RECURSIVE {GEN}, gp AS (SELECT generated_output AS pred, short_query AS ref FROM gen),
{scored('gp', whole=False, summary=False)}
SELECT g.product_id, g.model, {prf('o2', 'np - 1', 'nr - 1')} FROM gen g JOIN s_f s ON s.pred = g.generated_output AND s.ref = g.short_query""",
    "rouge_n_exploded": f"""WITH {PRODUCTS},
xp AS (SELECT product_id, tok, count(*) AS n FROM (SELECT product_id, unnest({tokens("coalesce(description, '')")}) AS tok FROM products) GROUP BY ALL),
xr AS (SELECT product_id, tok, count(*) AS n FROM (SELECT product_id, unnest({tokens('title')}) AS tok FROM products) GROUP BY ALL),
xo AS (SELECT product_id, sum(least(xp.n, xr.n)) AS o FROM xp JOIN xr USING (product_id, tok) GROUP BY ALL),
xn AS (SELECT product_id, coalesce(o, 0) AS o, coalesce(np, 0) AS np, coalesce(nr, 0) AS nr FROM products
  LEFT JOIN xo USING (product_id) LEFT JOIN (SELECT product_id, sum(n) AS np FROM xp GROUP BY ALL) USING (product_id)
  LEFT JOIN (SELECT product_id, sum(n) AS nr FROM xr GROUP BY ALL) USING (product_id))
SELECT product_id, {prf('o')} FROM xn""",
    "rouge_l": f"{DIALOG_PLAIN} SELECT d.conv_id, d.turn, {prf('lcs')} FROM dialog d JOIN s_f s ON s.pred = d.pred AND s.ref = d.ref",
    "rouge_lsum": f"""{DIALOG_SCORED} SELECT d.conv_id, d.turn, {prf('uni')}
FROM dialog d JOIN s_f s ON s.pred = {sentences('d.pred')} AND s.ref = {sentences('d.ref')}""",
    "rouge_scores": f"{RESULTS} SELECT product_id, model, {SCORE_LIST} FROM results",
    "truncate_tokens": f"""WITH {PRODUCTS} SELECT product_id, {join_list('w[1:512]')} AS tokens, len(w) > 512 AS was_truncated
FROM (SELECT product_id, {words(TRAIN_INPUT)} AS w FROM products)""",
    "build_vocab": f"WITH {PRODUCTS}, {VOCAB} SELECT token, id FROM vocab",
    "encode_tokens": f"""WITH {PRODUCTS}, {VOCAB}, {encoded('ei', TRAIN_INPUT, 512)}, {encoded('el', 'short_query', 30)}
SELECT i.product_id, i.ids AS input_ids, i.n::integer AS n_attention, l.ids AS labels FROM ei i JOIN el l USING (product_id)""",
    "decode_tokens": f"WITH {PRODUCTS}, {VOCAB}, {encoded('el', 'short_query', 30)} SELECT product_id, txt AS text FROM el",
    "subword_vocab": f"""WITH RECURSIVE {PRODUCTS}, {subword_ctes({'sd': 'description'})}
SELECT id, token, n FROM (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM {subwords_of('sd')}) GROUP BY id) JOIN ranks USING (id)""",
    "encode_subwords": f"""WITH RECURSIVE {PRODUCTS}, {subword_ctes({'si': TRAIN_INPUT, 'sl': 'short_query'})}
SELECT product_id, array_to_string(list_append(i.ids, 50256), ' ') AS input_ids, (len(i.ids) + 1)::integer AS n_attention,
  array_to_string(list_append(l.ids, 50256), ' ') AS labels
FROM {subwords_of('si', 511)} i JOIN {subwords_of('sl', 29)} l USING (product_id)""",
    "decode_subwords": f"WITH {PRODUCTS} SELECT product_id, coalesce(description, '') AS text FROM products",
    "cosine_similarity": f"WITH {VEC_PAIRS} SELECT vec_id, cosine FROM vecs",
    "text_vectors": f"""WITH {PRODUCTS} SELECT product_id, token, count(*) AS tf
FROM (SELECT product_id, unnest({tokens("coalesce(description, '')")}) AS token FROM products) GROUP BY ALL""",
    "word_information": f"""WITH {PRODUCTS},
texts AS (SELECT unnest([{tokens("coalesce(title, '')")}, {tokens("coalesce(description, '')")}]) AS w FROM products),
top AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) - 1)::integer AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM texts) GROUP BY token) QUALIFY id < 2000),
apart AS (SELECT unnest(w[1:len(w) - d]) AS x, unnest(w[d + 1:]) AS y, 60 // d AS w FROM texts, range(1, 6) g(d) WHERE len(w) > d),
near AS (SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, sum(w)::bigint AS w
  FROM apart JOIN top p ON p.token = x JOIN top q ON q.token = y GROUP BY ALL),
both_ways AS (SELECT a, b, w FROM near UNION ALL SELECT b, a, w FROM near WHERE a <> b),
sums AS (SELECT a, sum(w)::double AS s FROM both_ways GROUP BY a),
total AS (SELECT sum(s) AS t FROM sums)
SELECT m.a, m.b, round(ln(w::double * t / (x.s * y.s)), 6) AS v FROM both_ways m JOIN sums x ON x.a = m.a JOIN sums y ON y.a = m.b, total
WHERE ln(w::double * t / (x.s * y.s)) > 0""",
    "text_vectors_embedder": f"""WITH {PRODUCTS} SELECT product_id, concat_ws(' ', {', '.join(
        f"length(x) - length(replace(x, '{c}', ''))" for c in 'aeiou ')}) AS vector
FROM (SELECT product_id, coalesce(description, '') AS x FROM products)""",
    "semantic_similarity_embedder": f"""{RESULTS},
vowels AS (SELECT product_id, model, {', '.join(f"(length({x}) - length(replace({x}, '{c}', '')))::double AS {n}{i}"
        for n, x in (("a", "coalesce(target_query, 'None')"), ("b", "coalesce(generated_output, 'None')")) for i, c in enumerate('aeiou '))} FROM results),
sums AS (SELECT product_id, model, {' + '.join(f'a{i} * b{i}' for i in range(6))} AS dot,
  sqrt({' + '.join(f'a{i} * a{i}' for i in range(6))}) * sqrt({' + '.join(f'b{i} * b{i}' for i in range(6))}) AS norms FROM vowels)
SELECT product_id, model, CASE WHEN norms > 0 THEN round(dot / norms, 6) ELSE 0.0::double END AS semantic_similarity FROM sums""",
    "semantic_similarity": f"{RESULTS}, {SIMILAR} SELECT product_id, model, semantic_similarity FROM simrows",
    "batch_generate": f"WITH {GEN} SELECT product_id, model_ord, model, generated_output FROM gen",
    "evaluate_models": f"""{RESULTS} SELECT product_id, coalesce(title, 'None') AS title, coalesce(description, 'None') AS description,
input_text, target_query, model, generated_output, {SCORE_LIST} FROM results""",
    "evaluate_sample": f"{SAMPLED_RESULTS} SELECT model, {AVGS} FROM results GROUP BY model",
    "evaluate_save_analyze": f"{RESULTS} " + " UNION ALL ".join(
        [f"""SELECT 'averages' AS report, model AS name, '{c}_avg' AS metric, {mean(c)} AS value FROM results GROUP BY model""" for c in SCORES]
        + [f"""SELECT 'gap', 'lead-mid', '{c}', {mean(c, "FILTER (model = 'lead')")} - {mean(c, "FILTER (model = 'mid')")} FROM results""" for c in SCORES]
        + ["""SELECT 'best', product_id::varchar, generated_output, "rougeL" FROM results WHERE model = 'lead' AND "rougeL" >= 50"""]
    ),
    "analyze_results": f"""{RESULTS}, {BY_SIZE},
spread AS (SELECT model, count(*) FILTER (hi > lo) AS curves FROM (
  SELECT model, metric, min(value) AS lo, max(value) AS hi FROM ({long_scores(PAIR)}) GROUP BY ALL) GROUP BY model),
outperformed AS (SELECT a.target_query, a.generated_output AS a_output, b.generated_output AS b_output FROM results a JOIN results b ON a.target_query = b.target_query
  WHERE a.model = 'mid' AND b.model = 'lead' AND {OUTPERFORMED}),
counted AS (
  SELECT 'models' AS report, count(DISTINCT model) AS n, NULL::bigint AS content FROM results
  UNION ALL SELECT 'averages', count(DISTINCT model), NULL FROM results
  UNION ALL SELECT 'histogram', 2 * 4 * 20, NULL
  UNION ALL SELECT 'similarity_histogram', 25, NULL
  UNION ALL SELECT 'gap', 4, NULL
  UNION ALL SELECT 'similarity_correlation', 4, NULL
  UNION ALL SELECT 'lengths', 1, NULL
  UNION ALL SELECT 'density', sum(curves) * 200, NULL FROM spread
  UNION ALL SELECT 'histogram_overlay', sum(curves) * 200, NULL FROM spread
  UNION ALL SELECT 'outperformed', count(*), {content("target_query", "a_output", "b_output")} FROM outperformed
  UNION ALL SELECT 'zeros', count(*), {content("target_query", "generated_output")} FROM results WHERE model = 'lead' AND {ZERO}
  UNION ALL SELECT 'best', count(*), {content("target_query", "generated_output")} FROM results WHERE model = 'lead' AND "rougeL" >= 50
  UNION ALL SELECT 'worst', count(*), {content("target_query", "generated_output")} FROM results WHERE model = 'lead' AND "rougeL" <= 0
  UNION ALL SELECT 'by_size', count(*), NULL FROM sized
  UNION ALL SELECT 'by_size_diff', count(*), NULL FROM sized
  UNION ALL SELECT 'similarity', count(*), NULL FROM results WHERE model = 'lead'
  UNION ALL SELECT 'similarity_vs_rouge', 4 * count(*), NULL FROM results WHERE model = 'lead')
SELECT report, n::bigint AS n, content FROM counted""",
    "stream_metrics_merge": f"WITH {MERGED} SELECT {MERGED_COLUMNS} FROM merged",
    "stream_metrics_merge_by_key": f"WITH {MERGED} SELECT {MERGED_COLUMNS} FROM merged",
    "stream_metric_logs": BOTH_LOGS,
    "stream_final_metrics": f"WITH {LOGS} SELECT {FINAL_COLUMNS} FROM logs WHERE kind = 'final'",
    "stream_evaluate": f"{RESULTS} SELECT product_id, model, generated_output, {SCORE_LIST} FROM results",
}
