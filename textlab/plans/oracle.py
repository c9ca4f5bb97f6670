"""DuckDB oracle: one SQL string per registered query.

Tables (documents, conversations, ...) are views registered by the caller.
The SQL is generated from the same rule tables as the Spark expressions.
"""

from __future__ import annotations

from ..functions import rules as R
from ..operators import abbreviations as AB
from ..operators import lemma_rules as LR
from ..sources import lexicon
from ..sources.tables import PAIR_STRIDE
from . import sqlexpr as X

ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# Shared CTE bodies ---------------------------------------------------------

DOC_ARRAYS = f"""
docs_m AS (
  SELECT doc_id, lang, text, {X.mark_sentences('text', 'lang')} AS marked FROM documents
),
docs_a AS (
  SELECT doc_id, lang, text, {X.sentence_array('marked')} AS sents, {X.token_array('marked')} AS toks FROM docs_m
)"""

SENTENCES = f"""
{DOC_ARRAYS.strip()},
sents AS (
  SELECT doc_id, lang, unnest(range(0, len(sents))) AS sent_idx, unnest(sents) AS sent FROM docs_a
)"""

TOKENS = f"""
{SENTENCES.strip()},
sent_t AS (
  SELECT doc_id, lang, sent_idx, {X.sentence_tokens('sent')} AS toks FROM sents
),
toks AS (
  SELECT doc_id, lang, sent_idx, unnest(range(0, len(toks))) AS tok_idx, unnest(toks) AS token FROM sent_t
)"""

LEMMA_DICT = f"""
lemma_dict AS (
  SELECT lang, token, any_value(lemma) AS lemma FROM {lexicon.lemma_values_sql()} GROUP BY lang, token
)"""

# per document: statistics and distinct cleaned token / lemma types
DOC_TABLE_PLAIN = f"""
{DOC_ARRAYS.strip()},
doc_t AS (
  SELECT doc_id, lang, toks,
         len(toks)::BIGINT AS n_tokens, len(sents)::BIGINT AS n_sents,
         length(array_to_string(toks, ''))::BIGINT AS sum_token_len,
         {X.flesch('toks', 'len(sents)', 'lang')} AS fre,
         list_distinct({X.clean_tokens('toks')}) AS types
  FROM docs_a
)"""

DOC_TABLE_LEMMAS = f"""
{DOC_TABLE_PLAIN.strip()},
{LEMMA_DICT.strip()},
doc_dist AS (
  SELECT DISTINCT doc_id, lang, unnest(toks) AS token FROM doc_t
),
doc_lem AS (
  SELECT d.doc_id, count(DISTINCT {X.clean_token("coalesce(nullif(l.lemma, '--'), d.token)")}) AS n_lemma_types
  FROM doc_dist d LEFT JOIN lemma_dict l ON d.lang = l.lang AND d.token = l.token
  GROUP BY d.doc_id
)"""


def doc_stats_select(lemma: bool) -> str:
    n_types = "coalesce(dl.n_lemma_types, 0)" if lemma else "len(t.types)"
    join = "LEFT JOIN doc_lem dl ON t.doc_id = dl.doc_id" if lemma else ""
    return f"""
SELECT t.doc_id, t.lang, t.n_tokens, t.n_sents,
       round(t.sum_token_len::DOUBLE / nullif(t.n_tokens, 0)::DOUBLE, 6) AS avg_token_len,
       round(t.n_tokens::DOUBLE / nullif(t.n_sents, 0)::DOUBLE, 6) AS avg_sent_len,
       round({n_types}::DOUBLE / nullif(t.n_tokens, 0)::DOUBLE, 6) AS ttr,
       round(t.fre, 6) AS fre
FROM doc_t t {join}"""


# Queries --------------------------------------------------------------------

@oracle("enum_mask")
def _():
    m = X.enum_mask("text")
    return f"SELECT doc_id, {m} AS masked, ({X.enum_unmask(m)} = text) AS roundtrip FROM documents"


@oracle("paragraphs")
def _():
    return """
SELECT doc_id, para_idx, paragraph FROM (
  SELECT doc_id, unnest(range(0, len(p))) AS para_idx, unnest(p) AS paragraph
  FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)
)"""


@oracle("sentences")
def _():
    return f"WITH {SENTENCES.strip()}\nSELECT doc_id, sent_idx::BIGINT AS sent_idx, sent FROM sents"


@oracle("eval_sentences")
def _():
    s = X.sentence_array(X.plain_marked("text"))
    return f"""
SELECT doc_id, sent_idx::BIGINT AS sent_idx, sent FROM (
  SELECT doc_id, unnest(range(0, len(s))) AS sent_idx, unnest(s) AS sent
  FROM (SELECT doc_id, {s} AS s FROM documents)
)"""


@oracle("tokens")
def _():
    return f"WITH {TOKENS.strip()}\nSELECT doc_id, sent_idx::BIGINT AS sent_idx, tok_idx::BIGINT AS tok_idx, token FROM toks"


@oracle("eval_tokens")
def _():
    t = X.token_array(X.plain_marked("text"))
    return f"""
SELECT doc_id, tok_idx::BIGINT AS tok_idx, token FROM (
  SELECT doc_id, unnest(range(0, len(t))) AS tok_idx, unnest(t) AS token
  FROM (SELECT doc_id, {t} AS t FROM documents)
)"""


@oracle("newline_sentences")
def _():
    s = X.sentence_array(X.plain_marked("text"))
    return f"""
SELECT doc_id, array_to_string(s, chr(10)) AS text_nl, len(s)::BIGINT AS n_sents
FROM (SELECT doc_id, {s} AS s FROM documents)"""


@oracle("lemmas")
def _():
    return f"""
WITH {TOKENS.strip()},
{LEMMA_DICT.strip()}
SELECT t.doc_id, t.sent_idx::BIGINT AS sent_idx, t.tok_idx::BIGINT AS tok_idx, t.token,
       coalesce(nullif(l.lemma, '--'), t.token) AS lemma
FROM toks t LEFT JOIN lemma_dict l ON t.lang = l.lang AND t.token = l.token"""


LEMMA_GUESSES = f"""
{TOKENS.strip()},
{LEMMA_DICT.strip()},
edits AS (
  SELECT lang, token, lemma, length(token) AS size,
         len(list_filter(range(1, least(length(token), length(lemma)) + 1), lambda i: left(token, i) = left(lemma, i))) AS common
  FROM lemma_dict WHERE lemma <> '--' AND regexp_matches(token, '^\\p{{L}}+$')
),
cuts AS (
  SELECT *, unnest(range(greatest(1, size - common), least(size - 1, {LR.LONGEST}, size - common + {LR.CONTEXT}) + 1)) AS cut FROM edits WHERE common > 0
),
votes AS (
  SELECT lang, right(token, cut) AS suffix, substr(lemma, size - cut + 1) AS replacement, count(*) AS votes FROM cuts GROUP BY ALL
),
rules AS (
  SELECT lang, suffix, replacement FROM votes
  QUALIFY row_number() OVER (PARTITION BY lang, suffix ORDER BY votes DESC, replacement DESC) = 1
      AND 2 * votes > sum(votes) OVER (PARTITION BY lang, suffix)
),
unknown AS (
  SELECT DISTINCT t.lang, t.token FROM toks t ANTI JOIN lemma_dict l ON t.lang = l.lang AND t.token = l.token
),
guesses AS (
  SELECT u.lang, u.token, left(u.token, length(u.token) - length(r.suffix)) || r.replacement AS lemma, r.suffix
  FROM unknown u JOIN rules r ON u.lang = r.lang AND right(u.token, length(r.suffix)) = r.suffix
  WHERE regexp_matches(u.token, '^\\p{{L}}+$') AND length(u.token) - length(r.suffix) >= {LR.STEM}
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.token ORDER BY length(r.suffix) DESC) = 1
)"""


@oracle("lemma_rules")
def _():
    return f"WITH {LEMMA_GUESSES.strip()}\nSELECT lang, token, lemma, suffix FROM guesses"


@oracle("lemmas_guessed")
def _():
    return f"""
WITH {LEMMA_GUESSES.strip()}
SELECT t.doc_id, t.sent_idx::BIGINT AS sent_idx, t.tok_idx::BIGINT AS tok_idx, t.token, coalesce(nullif(l.lemma, '--'), g.lemma, t.token) AS lemma
FROM toks t LEFT JOIN lemma_dict l ON t.lang = l.lang AND t.token = l.token
LEFT JOIN guesses g ON t.lang = g.lang AND t.token = g.token"""


@oracle("vocab")
def _():
    return f"""
WITH {DOC_ARRAYS.strip()}
SELECT lang, token, count(*)::BIGINT AS cnt FROM (
  SELECT lang, {X.clean_token('tok')} AS token FROM (SELECT lang, unnest(toks) AS tok FROM docs_a)
) GROUP BY lang, token"""


@oracle("vocab_raw")
def _():
    return f"""
WITH {DOC_ARRAYS.strip()}
SELECT lang, token, count(*)::BIGINT AS cnt FROM (SELECT lang, unnest(toks) AS token FROM docs_a)
GROUP BY lang, token"""


@oracle("clean_tokens")
def _():
    return f"""
WITH {DOC_ARRAYS.strip()}
SELECT token, {X.clean_token('token')} AS cleaned FROM (SELECT DISTINCT unnest(toks) AS token FROM docs_a)"""


@oracle("doc_stats")
def _():
    return f"WITH {DOC_TABLE_PLAIN.strip()}\n{doc_stats_select(False)}"


@oracle("doc_stats_lemmas")
def _():
    return f"WITH {DOC_TABLE_LEMMAS.strip()}\n{doc_stats_select(True)}"


@oracle("flesch")
def _():
    return f"WITH {DOC_TABLE_PLAIN.strip()}\nSELECT doc_id, lang, round(fre, 6) AS fre FROM doc_t"


TYPES_BY_LANG = """
types_by AS (
  SELECT lang,
         count(DISTINCT CASE WHEN kind = 'raw' THEN t END)::BIGINT AS types_raw,
         count(DISTINCT CASE WHEN kind = 'lemma' THEN t END)::BIGINT AS types_lemmas
  FROM (
    SELECT lang, 'raw' AS kind, unnest(types) AS t FROM doc_t
    UNION ALL
    SELECT lang, 'lemma' AS kind, lt AS t FROM doc_lemma_types
  ) GROUP BY lang
)"""

DOC_LEMMA_TYPES = f"""
doc_lemma_types AS (
  SELECT DISTINCT d.doc_id, d.lang, {X.clean_token("coalesce(nullif(l.lemma, '--'), d.token)")} AS lt
  FROM doc_dist d LEFT JOIN lemma_dict l ON d.lang = l.lang AND d.token = l.token
)"""


@oracle("type_counts")
def _():
    return f"""
WITH {DOC_TABLE_LEMMAS.strip()},
{DOC_LEMMA_TYPES.strip()},
{TYPES_BY_LANG.strip()}
SELECT lang, types_raw, types_lemmas FROM types_by"""


@oracle("type_counts_approx")
def _():
    return f"""
WITH {DOC_TABLE_LEMMAS.strip()},
{DOC_LEMMA_TYPES.strip()},
{TYPES_BY_LANG.strip()}
SELECT lang, types_raw, types_lemmas, true AS raw_within_bound, true AS lemmas_within_bound FROM types_by"""


@oracle("corpus_stats")
def _():
    return f"""
WITH {DOC_TABLE_LEMMAS.strip()},
{DOC_LEMMA_TYPES.strip()},
{TYPES_BY_LANG.strip()},
per_doc AS (
  SELECT t.*, coalesce(dl.n_lemma_types, 0)::DOUBLE / nullif(t.n_tokens, 0)::DOUBLE AS ttr
  FROM doc_t t LEFT JOIN doc_lem dl ON t.doc_id = dl.doc_id
),
agg AS (
  SELECT lang, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens, sum(n_sents)::BIGINT AS sentences,
         avg(n_tokens) AS avg_words, avg(n_sents) AS avg_sents, avg(ttr) AS avg_ttr, avg(fre) AS avg_fre,
         sum(sum_token_len)::DOUBLE / nullif(sum(n_tokens), 0)::DOUBLE AS avg_word_len,
         sum(n_tokens)::DOUBLE / nullif(sum(n_sents), 0)::DOUBLE AS avg_sent_len
  FROM per_doc GROUP BY lang
)
SELECT a.lang, a.docs, a.tokens, a.sentences,
       coalesce(t.types_raw, 0)::BIGINT AS types_raw, coalesce(t.types_lemmas, 0)::BIGINT AS types_lemmas,
       round(a.avg_words, 6) AS avg_words, round(a.avg_sents, 6) AS avg_sents, round(a.avg_ttr, 6) AS avg_ttr,
       round(a.avg_fre, 6) AS avg_fre, round(a.avg_word_len, 6) AS avg_word_len,
       round(a.avg_sent_len, 6) AS avg_sent_len
FROM agg a LEFT JOIN types_by t ON a.lang = t.lang"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["oracle_sql", "ORACLE", "R", "PAIR_STRIDE"]


# ---------------------------------------------------------------- pairs, novelty, report

PAIRS = f"""
turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pairs AS (
  SELECT CASE conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         conv_id * {PAIR_STRIDE} + turn AS pair_id, 'en' AS lang, text AS source, next_text AS target
  FROM turns WHERE role = 'user' AND next_role = 'assistant'
)"""

DOC_PAIRS = f"""
pairs AS (
  SELECT CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         doc_id AS pair_id, lang, text AS source,
         array_to_string(list_filter({X.sentence_array(X.mark_sentences('text', 'lang'))}, lambda s, i: i % 2 = 1), ' ') AS target
  FROM documents
)"""


def side_table_sql(pairs_cte: str) -> str:
    """CTEs ending in side_t(pair_id, side, lang, n_tokens, n_sents, sum_token_len, fre, toks, lemmas)."""
    return f"""
{pairs_cte.strip()},
sides AS (
  SELECT pair_id, 'source' AS side, lang, source AS text FROM pairs
  UNION ALL
  SELECT pair_id, 'target' AS side, lang, target AS text FROM pairs
),
sides_m AS (SELECT pair_id, side, lang, {X.mark_sentences('text', 'lang')} AS marked FROM sides),
sides_a AS (
  SELECT pair_id, side, lang, {X.sentence_array('marked')} AS sents, {X.token_array('marked')} AS toks FROM sides_m
),
{LEMMA_DICT.strip()},
sides_x AS (
  SELECT pair_id, side, lang, unnest(range(0, len(toks))) AS pos, unnest(toks) AS token FROM sides_a
),
sides_l AS (
  SELECT x.pair_id, x.side, list(coalesce(nullif(l.lemma, '--'), x.token) ORDER BY x.pos) AS lemmas
  FROM sides_x x LEFT JOIN lemma_dict l ON x.lang = l.lang AND x.token = l.token
  GROUP BY x.pair_id, x.side
),
side_t AS (
  SELECT a.pair_id, a.side, a.lang, len(a.toks)::BIGINT AS n_tokens, len(a.sents)::BIGINT AS n_sents,
         length(array_to_string(a.toks, ''))::BIGINT AS sum_token_len,
         {X.flesch('a.toks', 'len(a.sents)', 'a.lang')} AS fre,
         a.toks, coalesce(l.lemmas, []::VARCHAR[]) AS lemmas
  FROM sides_a a LEFT JOIN sides_l l ON a.pair_id = l.pair_id AND a.side = l.side
),
side_s AS (
  SELECT *, len(list_distinct({X.clean_tokens('lemmas')}))::DOUBLE / nullif(n_tokens, 0)::DOUBLE AS ttr FROM side_t
),
pair_c AS (
  SELECT s.pair_id, {X.clean_tokens('s.lemmas')} AS a, {X.clean_tokens('t.lemmas')} AS b,
         t.n_tokens::DOUBLE / nullif(s.n_tokens, 0)::DOUBLE AS cmp
  FROM side_t s JOIN side_t t ON s.pair_id = t.pair_id AND s.side = 'source' AND t.side = 'target'
),
pair_g AS (
  SELECT pair_id, cmp, a AS a1, b AS b1, {X.ngrams('a', 2, 'x2')} AS a2, {X.ngrams('b', 2, 'y2')} AS b2,
         {X.ngrams('a', 3, 'x3')} AS a3, {X.ngrams('b', 3, 'y3')} AS b3
  FROM pair_c
),
per_pair AS (
  SELECT pair_id, cmp, {X.novelty('a1', 'b1', 1, clean=False)} AS nov_1,
         {X.novelty('a2', 'b2', 1, clean=False)} AS nov_2, {X.novelty('a3', 'b3', 1, clean=False)} AS nov_3
  FROM pair_g
)"""


def corpus_report_sql(pairs_cte: str) -> str:
    from .corpus_report import STAT_COLUMNS
    unpivot = " UNION ALL ".join(
        f"SELECT side, {i} AS ord, {X.q(name)} AS statistic, {c}::DOUBLE AS value FROM by_side"
        for i, (name, c) in enumerate(STAT_COLUMNS)
    )
    return f"""
WITH {side_table_sql(pairs_cte).strip()},
types_side AS (
  SELECT side,
         count(DISTINCT CASE WHEN kind = 'raw' THEN t END)::BIGINT AS types_raw,
         count(DISTINCT CASE WHEN kind = 'lemma' THEN t END)::BIGINT AS types_lemmas
  FROM (
    SELECT side, 'raw' AS kind, {X.clean_token('tk')} AS t FROM (SELECT side, unnest(toks) AS tk FROM side_t)
    UNION ALL
    SELECT side, 'lemma' AS kind, {X.clean_token('lm')} AS t FROM (SELECT side, unnest(lemmas) AS lm FROM side_t)
  ) GROUP BY side
),
by_side AS (
  SELECT a.side, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens, sum(n_sents)::BIGINT AS sentences,
         any_value(ts.types_raw) AS types_raw, any_value(ts.types_lemmas) AS types_lemmas,
         avg(n_tokens) AS avg_words, avg(n_sents) AS avg_sents, avg(ttr) AS avg_ttr, avg(fre) AS avg_fre,
         sum(sum_token_len)::DOUBLE / nullif(sum(n_tokens), 0)::DOUBLE AS avg_word_len,
         sum(n_tokens)::DOUBLE / nullif(sum(n_sents), 0)::DOUBLE AS avg_sent_len
  FROM side_s a LEFT JOIN types_side ts ON a.side = ts.side GROUP BY a.side
),
long AS ({unpivot}),
wide AS (
  SELECT ord, statistic, any_value(CASE WHEN side = 'source' THEN value END) AS source,
         any_value(CASE WHEN side = 'target' THEN value END) AS target
  FROM long GROUP BY ord, statistic
),
tail AS (
  SELECT 11 AS ord, 'Novelty (n=1)' AS statistic, NULL::DOUBLE AS source, avg(nov_1) * 100 AS target FROM per_pair
  UNION ALL SELECT 12, 'Novelty (n=2)', NULL, avg(nov_2) * 100 FROM per_pair
  UNION ALL SELECT 13, 'Novelty (n=3)', NULL, avg(nov_3) * 100 FROM per_pair
  UNION ALL SELECT 14, 'CMP', NULL, avg(cmp) FROM per_pair
),
report AS (SELECT * FROM wide UNION ALL SELECT * FROM tail)"""


@oracle("paired_corpus")
def _():
    return f"WITH {PAIRS.strip()}\nSELECT split, pair_id, source, target FROM pairs"


@oracle("ngrams")
def _():
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {n}::BIGINT AS n, len({X.ngrams('toks', n)})::BIGINT AS n_grams, "
        f"len(list_distinct({X.ngrams('toks', n)}))::BIGINT AS n_distinct FROM docs_a" for n in (1, 2, 3))
    return f"WITH {DOC_ARRAYS.strip()}\n{parts}"


PAIR_TOKENS = f"""
{PAIRS.strip()},
pt AS (
  SELECT pair_id, {X.token_array(X.mark_sentences('source', "'en'"))} AS src,
         {X.token_array(X.mark_sentences('target', "'en'"))} AS tgt FROM pairs
)"""

for _n in (1, 2, 3):
    ORACLE[f"novelty_{_n}"] = (
        f"WITH {PAIR_TOKENS.strip()},\n"
        f"pc AS (SELECT pair_id, {X.clean_tokens('src')} AS a, {X.clean_tokens('tgt')} AS b FROM pt),\n"
        f"pg AS (SELECT pair_id, {X.ngrams('a', _n, 'x')} AS ga, {X.ngrams('b', _n, 'y')} AS gb FROM pc)\n"
        f"SELECT pair_id, round({X.novelty('ga', 'gb', 1, clean=False)}, 6) AS novelty FROM pg")


@oracle("compression")
def _():
    return f"""WITH {PAIR_TOKENS.strip()}
SELECT pair_id, len(src)::BIGINT AS src_tokens, len(tgt)::BIGINT AS tgt_tokens,
       round(len(tgt)::DOUBLE / nullif(len(src), 0)::DOUBLE, 6) AS cmp FROM pt"""


@oracle("corpus_report")
def _():
    return corpus_report_sql(PAIRS) + "\nSELECT ord::BIGINT AS ord, statistic, round(source, 6) AS source, round(target, 6) AS target FROM report"


@oracle("corpus_report_docs")
def _():
    return corpus_report_sql(DOC_PAIRS) + "\nSELECT ord::BIGINT AS ord, statistic, round(source, 6) AS source, round(target, 6) AS target FROM report"


@oracle("corpus_report_formatted")
def _():
    ints = ", ".join(X.q(name) for name, kind, _ in R.CORPUS_REPORT_ROWS if kind == "int")

    def cell(c):
        return (f"CASE WHEN {c} IS NULL THEN '' WHEN statistic IN ({ints}) THEN format('{{:,.0f}}', {c}) "
                f"ELSE format('{{:.2f}}', {c}) END")
    return corpus_report_sql(PAIRS) + f"""
SELECT ord::BIGINT AS ord, statistic, {cell('source')} AS "Source", {cell('target')} AS "Target" FROM report WHERE ord < 11
UNION ALL
SELECT 11, 'Novelty', '', string_agg(format('{{:.0f}}', target), '/' ORDER BY ord) || '%'
FROM report WHERE statistic LIKE 'Novelty%'
UNION ALL
SELECT 12, 'CMP', '', format('{{:.2f}}', target) FROM report WHERE statistic = 'CMP'"""


@oracle("corpus_novelty")
def _():
    return corpus_report_sql(PAIRS) + """
SELECT round(avg(nov_1) * 100, 6) AS nov_1, round(avg(nov_2) * 100, 6) AS nov_2, round(avg(nov_3) * 100, 6) AS nov_3,
       format('{:.0f}/{:.0f}/{:.0f}%', avg(nov_1) * 100, avg(nov_2) * 100, avg(nov_3) * 100) AS novelty
FROM per_pair"""


# ---------------------------------------------------------------- evaluation

def _line(expr: str) -> str:
    return X.strip(f"regexp_replace({expr}, '\\r\\n|\\r|\\n', ' ', 'g')")


EVAL = f"""
{PAIRS.strip()},
ev AS (
  SELECT 'identity' AS system, split, pair_id, source AS orig, target AS ref, source AS sys FROM pairs
  UNION ALL SELECT 'gold', split, pair_id, source, target, target FROM pairs
  UNION ALL SELECT 'lead3', split, pair_id, source, target,
         array_to_string({X.sentence_array(X.plain_marked('source'))}[1:3], ' ') FROM pairs
)"""

# the same, written to line files and read back
EVAL_LINES = f"""
{EVAL.strip().replace('ev AS (', 'ev0 AS (')},
ev AS (
  SELECT system, '' AS split, row_number() OVER (PARTITION BY system ORDER BY pair_id) - 1 AS pair_id,
         {_line('orig')} AS orig, {_line('ref')} AS ref, {_line('sys')} AS sys
  FROM ev0
)"""


def _gram_specs() -> list[tuple[str, int, int, str]]:
    specs = []
    for n in (1, 2):
        specs += [("rouge", n, 1, "r_ref"), ("rouge", n, 2, "r_sys")]
    for n in (1, 2, 3, 4):
        specs += [("bleu", n, 1, "b_ref"), ("bleu", n, 2, "b_sys")]
        specs += [("sari", n, 0, "s_orig"), ("sari", n, 1, "s_ref"), ("sari", n, 2, "s_sys")]
    return specs


STATS = f"""
tk AS (
  SELECT system, split, pair_id,
         {X.rouge_tokens('ref')} AS r_ref, {X.rouge_tokens('sys')} AS r_sys,
         {X.tokens_13a('ref')} AS b_ref, {X.tokens_13a('sys')} AS b_sys,
         {X.tokens_13a('orig', True)} AS s_orig, {X.tokens_13a('ref', True)} AS s_ref,
         {X.tokens_13a('sys', True)} AS s_sys
  FROM ev
),
gl AS (
  {" UNION ALL ".join(f"SELECT system, split, pair_id, '{k}' AS kind, {n} AS n, {side} AS side, {X.ngrams(c, n, 'v')} AS lst FROM tk"
                     for k, n, side, c in _gram_specs())}
),
gx AS (
  SELECT system, split, pair_id, kind, n, side,
         unnest(CASE WHEN len(lst) = 0 THEN [NULL::VARCHAR] ELSE lst END) AS gram
  FROM gl
),
counts AS (
  SELECT system, split, pair_id, kind, n, gram,
         count(*) FILTER (WHERE gram IS NOT NULL AND side = 0) AS c_orig,
         count(*) FILTER (WHERE gram IS NOT NULL AND side = 1) AS c_ref,
         count(*) FILTER (WHERE gram IS NOT NULL AND side = 2) AS c_sys
  FROM gx GROUP BY system, split, pair_id, kind, n, gram
),
st AS (
  SELECT system, split, pair_id, kind, n,
         sum(least(c_sys, c_ref)) AS hits, sum(c_sys) AS sys_total, sum(c_ref) AS ref_total,
         count(*) FILTER (WHERE c_sys > 0 AND c_orig = 0) AS add_sys,
         count(*) FILTER (WHERE c_ref > 0 AND c_orig = 0) AS add_ref,
         count(*) FILTER (WHERE c_sys > 0 AND c_ref > 0 AND c_orig = 0) AS add_ok,
         sum(least(c_orig, c_sys)) AS keep_sys, sum(least(c_orig, c_ref)) AS keep_ref,
         sum(least(c_orig, c_sys, c_ref)) AS keep_ok,
         sum(greatest(c_orig - c_sys, 0)) AS del_sys, sum(greatest(c_orig - c_ref, 0)) AS del_ref,
         sum(least(greatest(c_orig - c_sys, 0), greatest(c_orig - c_ref, 0))) AS del_ok
  FROM counts GROUP BY system, split, pair_id, kind, n
),
rouge AS (
  SELECT system, n, avg(p) * 100 AS precision, avg(r) * 100 AS recall,
         avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) * 100 AS fmeasure
  FROM (SELECT system, n, hits::DOUBLE / greatest(sys_total, 1) AS p, hits::DOUBLE / greatest(ref_total, 1) AS r
        FROM st WHERE kind = 'rouge')
  GROUP BY system, n
),
bleu_c AS (
  SELECT system,
         {", ".join(f"sum(hits) FILTER (WHERE n = {n}) AS c{n}, sum(sys_total) FILTER (WHERE n = {n}) AS t{n}" for n in (1, 2, 3, 4))},
         sum(ref_total) FILTER (WHERE n = 1) AS ref_len
  FROM st WHERE kind = 'bleu' GROUP BY system
),
bleu_k AS (
  SELECT *, {", ".join(
      "(" + " + ".join(f"(CASE WHEN t{m} > 0 AND c{m} = 0 THEN 1 ELSE 0 END)" for m in range(1, n + 1)) + f") AS k{n}"
      for n in (1, 2, 3, 4))}
  FROM bleu_c
),
bleu_p AS (
  SELECT *, {", ".join(
      f"(CASE WHEN t{n} = 0 THEN 0.0 WHEN c{n} > 0 THEN 100.0 * c{n} / t{n} ELSE 100.0 / (pow(2.0, k{n}) * t{n}) END) AS p{n}"
      for n in (1, 2, 3, 4))}
  FROM bleu_k
),
bleu AS (
  SELECT system,
         (CASE WHEN t1 >= ref_len THEN 1.0 WHEN t1 > 0 THEN exp(1 - ref_len::DOUBLE / t1) ELSE 0.0 END)
         * exp(({" + ".join(f"(CASE WHEN p{n} > 0 THEN ln(p{n}) ELSE -9999999999.0 END)" for n in (1, 2, 3, 4))}) / 4) AS bleu
  FROM bleu_p
),
sari_n AS (
  SELECT system, n, {", ".join(f"sum({c}) AS {c}" for c in
      ("add_sys", "add_ref", "add_ok", "keep_sys", "keep_ref", "keep_ok", "del_sys", "del_ref", "del_ok"))}
  FROM st WHERE kind = 'sari' GROUP BY system, n
),
sari_f AS (
  SELECT system, {", ".join(
      f"(CASE WHEN p_{op} + r_{op} > 0 THEN 2 * p_{op} * r_{op} / (p_{op} + r_{op}) ELSE 0.0 END) AS f_{op}"
      for op in ("add", "keep", "del"))}
  FROM (SELECT system, {", ".join(
      f"(CASE WHEN {op}_sys > 0 THEN {op}_ok::DOUBLE / {op}_sys ELSE 0.0 END) AS p_{op}, "
      f"(CASE WHEN {op}_ref > 0 THEN {op}_ok::DOUBLE / {op}_ref ELSE 0.0 END) AS r_{op}"
      for op in ("add", "keep", "del"))} FROM sari_n)
),
sari AS (
  SELECT system, avg(f_add) * 100 AS sari_add, avg(f_keep) * 100 AS sari_keep, avg(f_del) * 100 AS sari_del,
         (avg(f_add) * 100 + avg(f_keep) * 100 + avg(f_del) * 100) / 3 AS sari
  FROM sari_f GROUP BY system
),
surf_t AS (
  SELECT system, {X.token_array(X.plain_marked('orig'))} AS xt, {X.token_array(X.plain_marked('sys'))} AS yt,
         len({X.sentence_array(X.plain_marked('orig'))}) AS xs, len({X.sentence_array(X.plain_marked('sys'))}) AS ys
  FROM ev
),
surf_c AS (
  SELECT *, {X.clean_tokens('xt', 'c1')} AS xc, {X.clean_tokens('yt', 'c2')} AS yc FROM surf_t
),
surf_g AS (
  SELECT *, {X.ngrams('xc', 2, 'v1')} AS x2, {X.ngrams('yc', 2, 'v2')} AS y2 FROM surf_c
),
surface AS (
  SELECT system, avg(len(xt)) AS x_w, avg(xs) AS x_s, avg(len(yt)) AS y_w, avg(ys) AS y_s,
         avg(len(yt)::DOUBLE / nullif(len(xt), 0)::DOUBLE) AS cmp_w, avg(ys::DOUBLE / nullif(xs, 0)::DOUBLE) AS cmp_s,
         avg({X.novelty('xc', 'yc', 1, clean=False)} * 100) AS nov_1,
         avg({X.novelty('x2', 'y2', 1, clean=False)} * 100) AS nov_2
  FROM surf_g GROUP BY system
),
metrics AS (
  SELECT system, 'R-' || n AS metric, fmeasure AS value FROM rouge
  UNION ALL SELECT system, 'R-' || n || '_p', precision FROM rouge
  UNION ALL SELECT system, 'R-' || n || '_r', recall FROM rouge
  UNION ALL SELECT system, 'BLEU', bleu FROM bleu
  UNION ALL SELECT system, 'SARI', sari FROM sari
  {" ".join(f"UNION ALL SELECT system, '{m}', {c} FROM surface" for m, c in [
      ("|x|_w", "x_w"), ("|x|_s", "x_s"), ("|y|_w", "y_w"), ("|y|_s", "y_s"), ("CMP_w", "cmp_w"),
      ("CMP_s", "cmp_s"), ("Nov. (n=1)", "nov_1"), ("Nov. (n=2)", "nov_2")])}
)"""

EVAL_STATS = f"{EVAL.strip()},\n{STATS.strip()}"


def _pieces(text: str) -> str:
    """ROUGE-Lsum token lists: sentences, split on newlines, empty pieces dropped."""
    lines = f"flatten(list_transform({X.sentence_array(X.plain_marked(text))}, lambda s: string_split(s, chr(10))))"
    return f"list_transform(list_filter({lines}, lambda p: length(p) > 0), lambda p: {X.rouge_tokens('p')})"


# CTEs (recursive) from ev to lsum(system, precision, recall, fmeasure): the
# LCS table of each (reference sentence, candidate sentence) row by row, then
# the walk back through it.
LSUM = f"""
ls AS (SELECT system, split, pair_id, {_pieces('ref')} AS refs, {_pieces('sys')} AS cans FROM ev),
lr AS (SELECT system, split, pair_id, cans, unnest(range(1, len(refs) + 1)) AS ri, unnest(refs) AS rt FROM ls),
lq0 AS (SELECT system, split, pair_id, ri, rt, unnest(cans) AS ct FROM lr),
lq AS (
  SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT rt, ct FROM lq0 WHERE len(rt) > 0 AND len(ct) > 0)
),
dp AS MATERIALIZED (
  SELECT k, 0 AS i, list_transform(range(0, len(ct) + 1), lambda z: 0) AS cells FROM lq
  UNION ALL
  SELECT k, i + 1, list_transform(range(1, len(cells) + 1), lambda j: list_max(best[1:j])) FROM (
    SELECT dp.k, dp.i, dp.cells, list_transform(range(1, len(dp.cells) + 1), lambda j:
             CASE WHEN j = 1 THEN 0 WHEN lq.rt[dp.i + 1] = lq.ct[j - 1] THEN greatest(dp.cells[j], dp.cells[j - 1] + 1)
                  ELSE greatest(dp.cells[j], dp.cells[j - 1]) END) AS best
    FROM dp JOIN lq ON dp.k = lq.k WHERE dp.i < len(lq.rt)
  )
),
walk AS (
  SELECT k, len(rt) AS i, len(ct) AS j, []::BIGINT[] AS hit FROM lq
  UNION ALL
  SELECT k, CASE WHEN m OR NOT go_left THEN i - 1 ELSE i END, CASE WHEN m OR go_left THEN j - 1 ELSE j END,
         CASE WHEN m THEN list_append(hit, i) ELSE hit END
  FROM (
    SELECT w.k, w.i, w.j, w.hit, lq.rt[w.i] = lq.ct[w.j] AS m, here.cells[w.j] > above.cells[w.j + 1] AS go_left
    FROM walk w JOIN lq ON w.k = lq.k JOIN dp here ON w.k = here.k AND w.i = here.i
         JOIN dp above ON w.k = above.k AND w.i = above.i + 1
    WHERE w.i > 0 AND w.j > 0
  )
),
hits AS (SELECT k, hit FROM walk WHERE i = 0 OR j = 0),
united AS (
  SELECT DISTINCT q.system, q.split, q.pair_id, q.ri, q.rt, unnest(h.hit) AS pos
  FROM lq0 q JOIN lq ON q.rt = lq.rt AND q.ct = lq.ct JOIN hits h ON lq.k = h.k
),
u_t AS (SELECT system, split, pair_id, rt[pos] AS t, count(*) AS u FROM united GROUP BY ALL),
c_t AS (
  SELECT system, split, pair_id, t, count(*) AS c FROM (SELECT system, split, pair_id, unnest(flatten(cans)) AS t FROM ls) GROUP BY ALL
),
l_hits AS (
  SELECT system, split, pair_id, sum(least(u, c)) AS hits FROM u_t JOIN c_t USING (system, split, pair_id, t) GROUP BY ALL
),
l_pr AS (
  SELECT system, CASE WHEN n > 0 THEN h / n ELSE 0.0 END AS p, CASE WHEN m > 0 THEN h / m ELSE 0.0 END AS r FROM (
    SELECT ls.system, coalesce(hits, 0)::DOUBLE AS h, len(flatten(cans)) AS n, len(flatten(refs)) AS m
    FROM ls LEFT JOIN l_hits x ON ls.system = x.system AND ls.split = x.split AND ls.pair_id = x.pair_id
  )
),
lsum AS (
  SELECT system, avg(p) * 100 AS precision, avg(r) * 100 AS recall,
         avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) * 100 AS fmeasure
  FROM l_pr GROUP BY system
),
all_metrics AS (
  SELECT system, metric, value FROM metrics
  UNION ALL SELECT system, 'R-L', fmeasure FROM lsum
  UNION ALL SELECT system, 'R-L_p', precision FROM lsum
  UNION ALL SELECT system, 'R-L_r', recall FROM lsum
)"""

REPORT_METRICS = ["R-1", "R-2", "BLEU", "SARI", "|y|_w", "CMP_w", "Nov. (n=1)", "Nov. (n=2)"]


@oracle("eval_table")
def _():
    return f"WITH {EVAL_LINES.strip()}\nSELECT system, pair_id::BIGINT AS line_no, orig, ref, sys FROM ev"


@oracle("eval_table_indexed")
def _():
    return ORACLE["eval_table"]


@oracle("rouge_lsum")
def _():
    return (f"WITH RECURSIVE {EVAL_STATS.strip()},\n{LSUM.strip()}\nSELECT system, round(precision, 6) AS precision, "
            f"round(recall, 6) AS recall, round(fmeasure, 6) AS fmeasure FROM lsum")


@oracle("evaluate_runs")
def _():
    return (f"WITH RECURSIVE {EVAL_LINES.strip()},\n{STATS.strip()},\n{LSUM.strip()}\n"
            f"SELECT system, metric, round(value, 6) AS value FROM all_metrics")


@oracle("rouge_1")
def _():
    return (f"WITH {EVAL_STATS.strip()}\nSELECT system, round(precision, 6) AS precision, round(recall, 6) AS recall, "
            f"round(fmeasure, 6) AS fmeasure FROM rouge WHERE n = 1")


@oracle("rouge_2")
def _():
    return (f"WITH {EVAL_STATS.strip()}\nSELECT system, round(precision, 6) AS precision, round(recall, 6) AS recall, "
            f"round(fmeasure, 6) AS fmeasure FROM rouge WHERE n = 2")


@oracle("bleu")
def _():
    return f"WITH {EVAL_STATS.strip()}\nSELECT system, round(bleu, 6) AS bleu FROM bleu"


@oracle("sari")
def _():
    return (f"WITH {EVAL_STATS.strip()}\nSELECT system, round(sari_add, 6) AS sari_add, round(sari_keep, 6) AS sari_keep, "
            f"round(sari_del, 6) AS sari_del, round(sari, 6) AS sari FROM sari")


@oracle("surface_stats")
def _():
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in ("x_w", "x_s", "y_w", "y_s", "cmp_w", "cmp_s", "nov_1", "nov_2"))
    return f"WITH {EVAL_STATS.strip()}\nSELECT system, {cols} FROM surface"


@oracle("metric_means")
def _():
    return f"WITH {EVAL_STATS.strip()}\nSELECT system, metric, round(value, 6) AS value FROM metrics"


@oracle("metric_report")
def _():
    cols = ", ".join(f"format('{{:.2f}}', any_value(value) FILTER (WHERE metric = {X.q(m)}))::DOUBLE AS \"{m}\"" for m in REPORT_METRICS)
    return f"WITH {EVAL_STATS.strip()}\nSELECT system, {cols} FROM metrics GROUP BY system"


# ---------------------------------------------------------------- sections, clean-up

SECTIONS = f"""
parts AS (
  SELECT doc_id, regexp_extract_all(text, {X.q(R.DEFAULT_TITLE_PATTERN)}, 0) AS titles,
         regexp_extract_all(text, {X.q(R.DEFAULT_TITLE_PATTERN)}, 1) AS norms,
         regexp_split_to_array(text, {X.q(R.DEFAULT_TITLE_PATTERN)}) AS bodies
  FROM documents
),
nz AS (SELECT * FROM parts WHERE len(titles) > 0),
m AS (
  SELECT doc_id, length(bodies[1]) AS pre_len, unnest(range(0, len(titles))) AS i, unnest(titles) AS title,
         unnest(norms) AS norm, unnest(bodies[2:]) AS body
  FROM nz
),
ms AS (
  SELECT *, pre_len + coalesce(sum(length(title) + length(body)) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM m
),
secs AS (
  SELECT doc_id, (i + CASE WHEN pre_len > 0 THEN 1 ELSE 0 END)::INTEGER AS "index", st::INTEGER AS start,
         (st + length(title) + length(body))::INTEGER AS "end", title, norm AS title_normalized,
         st::INTEGER AS title_start, (st + length(title))::INTEGER AS title_end, body AS text,
         (st + length(title))::INTEGER AS text_start, (st + length(title) + length(body))::INTEGER AS text_end
  FROM ms
  UNION ALL
  SELECT doc_id, 0, 0, length(bodies[1])::INTEGER, {X.q(R.UNNAMED_TITLE)}, {X.q(R.UNNAMED_TITLE)},
         NULL::INTEGER, NULL::INTEGER, bodies[1], 0, length(bodies[1])::INTEGER
  FROM nz WHERE length(bodies[1]) > 0
)"""


@oracle("sections")
def _():
    return f"WITH {SECTIONS.strip()}\nSELECT * FROM secs"


@oracle("sections_preamble")
def _():
    return f"WITH {SECTIONS.strip()}\nSELECT * FROM secs WHERE title_start IS NULL"


@oracle("next_section")
def _():
    return (f"WITH {SECTIONS.strip()}\nSELECT doc_id, \"index\", title_normalized, "
            f"lead(title_normalized) OVER (PARTITION BY doc_id ORDER BY \"index\") AS next_title FROM secs")


@oracle("strip_text")
def _():
    return (f"SELECT conv_id, turn, {X.strip('text')} AS stripped, length({X.strip('text')})::BIGINT AS n_chars "
            f"FROM conversations")


@oracle("text_cleanup")
def _():
    spaced = "array_to_string(toks, ' ')"
    return f"WITH {DOC_ARRAYS.strip()}\nSELECT doc_id, {X.cleanup(spaced)} AS cleaned FROM docs_a"


# ---------------------------------------------------------------- training-data preparation

def encode_sql(prefix: str = "", max_src: int = 1024, max_tgt: int = 128, val_max_tgt: int | None = None) -> str:
    val_max_tgt = max_tgt if val_max_tgt is None else val_max_tgt
    src_text = f"({X.q(prefix)} || source)" if prefix else "source"
    return f"""
{PAIRS.strip()},
pt AS (
  SELECT split, pair_id, {X.token_array(X.mark_sentences(src_text, "'en'"))} AS src,
         {X.token_array(X.mark_sentences('target', "'en'"))} AS tgt
  FROM pairs
),
vc AS (
  SELECT token, count(*)::BIGINT AS cnt FROM (SELECT unnest(list_concat(src, tgt)) AS token FROM pt WHERE split = 'train')
  GROUP BY token
),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 1)::INTEGER AS id, cnt FROM vc
),
sx AS (
  SELECT split, pair_id, 'input_ids' AS side, unnest(range(0, len(s))) AS pos, unnest(s) AS token
  FROM (SELECT split, pair_id, src[1:{max_src}] AS s FROM pt)
  UNION ALL
  SELECT split, pair_id, 'labels', unnest(range(0, len(s))), unnest(s)
  FROM (SELECT split, pair_id, CASE WHEN split = 'train' THEN tgt[1:{max_tgt}] ELSE tgt[1:{val_max_tgt}] END AS s FROM pt)
),
sid AS (
  SELECT x.split, x.pair_id, x.side, x.pos, x.token, v.id AS vid, coalesce(v.id, 1) AS id
  FROM sx x LEFT JOIN vocab v ON x.token = v.token
),
ids AS (
  SELECT split, pair_id, side, list(id ORDER BY pos) AS ids,
         list(CASE WHEN vid IS NOT NULL THEN token END ORDER BY pos) AS dec
  FROM sid GROUP BY split, pair_id, side
),
enc AS (
  SELECT p.split, p.pair_id, coalesce(i.ids, []::INTEGER[]) AS input_ids, coalesce(l.ids, []::INTEGER[]) AS labels,
         coalesce(i.dec, []::VARCHAR[]) AS input_dec
  FROM pt p
  LEFT JOIN ids i ON p.pair_id = i.pair_id AND i.side = 'input_ids'
  LEFT JOIN ids l ON p.pair_id = l.pair_id AND l.side = 'labels'
)"""


def _pad(col: str, n: int) -> str:
    return f"list_concat({col}, list_transform(range(0, greatest({n} - len({col}), 0)), lambda z: 0))"


@oracle("prefix_source")
def _():
    return f"WITH {PAIRS.strip()}\nSELECT pair_id, 'simplify: ' || source AS prefixed FROM pairs"


@oracle("first_n")
def _():
    return (f"WITH {PAIRS.strip()}\nSELECT split, pair_id, source, target FROM pairs "
            f"QUALIFY row_number() OVER (PARTITION BY split ORDER BY pair_id) <= 10")


@oracle("vocab_ids")
def _():
    return f"WITH {encode_sql().strip()}\nSELECT token, id, cnt FROM vocab"


@oracle("encode_pairs")
def _():
    return (f"WITH {encode_sql('simplify: ', 1024, 128, 64).strip()}\n"
            "SELECT split, pair_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels, "
            "len(input_ids)::BIGINT AS n_input, len(labels)::BIGINT AS n_labels FROM enc")


@oracle("pad_pairs")
def _():
    pin, plab = _pad("input_ids", 256), _pad("labels", 128)
    return (f"WITH {encode_sql('', 256, 128).strip()}\n"
            f"SELECT split, pair_id, array_to_string({pin}, ' ') AS input_ids, len(input_ids)::BIGINT AS n_attended, "
            f"array_to_string(list_transform({plab}, lambda y: CASE WHEN y = 0 THEN -100 ELSE y END), ' ') AS labels FROM enc")


@oracle("decode_ids")
def _():
    return (f"WITH {encode_sql().strip()}\n"
            "SELECT split, pair_id, array_to_string(list_filter(input_dec, lambda z: z IS NOT NULL), ' ') AS text FROM enc")


@oracle("gen_len")
def _():
    return f"WITH {encode_sql().strip()}\nSELECT split, round(avg(len(labels)), 6) AS gen_len FROM enc GROUP BY split"


# ---------------------------------------------------------------- sources and sinks

@oracle("read_lines")
def _():
    return f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line_no, {_line('text')} AS line FROM documents"


@oracle("read_lines_indexed")
def _():
    return ORACLE["read_lines"]


@oracle("pair_lines")
def _():
    return f"""
WITH {DOC_PAIRS.strip()},
s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, {_line('text')} AS source FROM documents),
t AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS n, {_line('target')} AS target FROM pairs WHERE pair_id % 10 <> 9)
SELECT s.n::BIGINT AS pair_id, source, target FROM s JOIN t ON s.n = t.n"""


@oracle("jsonl_roundtrip")
def _():
    return f"WITH {PAIRS.strip()}\nSELECT split, pair_id, source, target FROM pairs"


ORACLE["corpus_union"] = ORACLE["jsonl_roundtrip"]

RUNS = f"""
{EVAL.strip()},
runs AS (
  SELECT system, (row_number() OVER (PARTITION BY system ORDER BY pair_id) - 1)::BIGINT AS line_no,
         {_line('sys')} AS sys
  FROM ev
)"""


@oracle("load_runs")
def _():
    return f"WITH {RUNS.strip()}\nSELECT system, line_no, sys FROM runs"


@oracle("alignment_check")
def _():
    return f"""WITH {RUNS.strip()},
given AS (
  SELECT system FROM runs UNION ALL SELECT 'short' FROM pairs WHERE pair_id % 5 <> 0
)
SELECT system, (SELECT count(source) FROM pairs) AS n_orig, (SELECT count(target) FROM pairs) AS n_ref,
       count(*) AS n_sys, count(*) = (SELECT count(source) FROM pairs) AND count(*) = (SELECT count(target) FROM pairs) AS aligned
FROM given GROUP BY system"""


@oracle("convert_splits")
def _():
    return f"""WITH {PAIRS.strip()}
SELECT split, (row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1)::BIGINT AS line_no,
       {_line('source')} AS source, {_line('target')} AS target
FROM pairs"""


@oracle("clean_predictions")
def _():
    return f"""WITH {EVAL.strip()}
SELECT system, (row_number() OVER (PARTITION BY system ORDER BY pair_id) - 1)::BIGINT AS line_no,
       {_line(X.cleanup(X.strip('sys')))} AS line
FROM ev"""


@oracle("document_table")
def _():
    return f"""
WITH {TOKENS.strip()},
{LEMMA_DICT.strip()},
tl AS (
  SELECT t.doc_id, t.sent_idx, t.tok_idx, t.token, coalesce(nullif(l.lemma, '--'), t.token) AS lemma
  FROM toks t LEFT JOIN lemma_dict l ON t.lang = l.lang AND t.token = l.token
),
ps AS (
  SELECT doc_id, sent_idx, string_agg(token, ' ' ORDER BY tok_idx) AS tks, string_agg(lemma, ' ' ORDER BY tok_idx) AS lms
  FROM tl GROUP BY doc_id, sent_idx
),
pd AS (
  SELECT d.doc_id, s.sent_idx, s.sent, ps.tks, ps.lms
  FROM documents d LEFT JOIN sents s ON d.doc_id = s.doc_id LEFT JOIN ps ON s.doc_id = ps.doc_id AND s.sent_idx = ps.sent_idx
)
SELECT doc_id, count(sent_idx)::BIGINT AS n_sents, coalesce(string_agg(sent, chr(1) ORDER BY sent_idx), '') AS sents,
       coalesce(string_agg(tks, chr(1) ORDER BY sent_idx), '') AS tokens, coalesce(string_agg(lms, chr(1) ORDER BY sent_idx), '') AS lemmas
FROM pd GROUP BY doc_id"""


@oracle("encoded_sample")
def _():
    return (f"WITH {encode_sql().strip()}\n"
            "SELECT e.pair_id, array_to_string(e.input_ids, ' ') AS input_ids, array_to_string(e.labels, ' ') AS labels, "
            "array_to_string(list_filter(e.input_dec, lambda z: z IS NOT NULL), ' ') AS input_tokens, "
            "array_to_string(list_filter(l.dec, lambda z: z IS NOT NULL), ' ') AS labels_tokens "
            "FROM enc e LEFT JOIN ids l ON e.pair_id = l.pair_id AND l.side = 'labels' "
            "WHERE e.split = 'train' ORDER BY e.pair_id LIMIT 1")


@oracle("saved_metrics")
def _():
    return (f"WITH {EVAL_STATS.strip()}\nSELECT 'test' AS prefix, system, metric, round(value, 6) AS value FROM metrics\n"
            f"UNION ALL SELECT 'test', system, 'test_samples', count(*)::DOUBLE FROM ev GROUP BY system")


@oracle("decoded_metrics")
def _():
    from .queries import PREDICTED_TOKENS, TRAINING_METRICS

    def text(arr):
        return f"array_to_string(list_filter({arr}, lambda z: z IS NOT NULL), ' ')"

    names = ", ".join(X.q(m) for m in TRAINING_METRICS)
    return f"""WITH RECURSIVE {encode_sql().strip()},
ev AS (
  SELECT 'decoded' AS system, e.split, e.pair_id, {text('e.input_dec')} AS orig,
         {text("coalesce(l.dec, []::VARCHAR[])")} AS ref, {text(f"e.input_dec[1:{PREDICTED_TOKENS}]")} AS sys
  FROM enc e LEFT JOIN ids l ON e.pair_id = l.pair_id AND l.side = 'labels'
),
{STATS.strip()},
{LSUM.strip()}
SELECT system, metric, format('{{:.4f}}', value)::DOUBLE AS value FROM all_metrics WHERE metric IN ({names})
UNION ALL
SELECT 'decoded', 'gen_len', format('{{:.4f}}', avg(len(input_ids[1:{PREDICTED_TOKENS}])))::DOUBLE FROM enc"""


# ---------------------------------------------------------------- further inventory keys

def _marked_all_langs(text: str) -> str:
    words = R.EXTRA_ABBREVIATIONS["de"]
    t = X.rx(X.escape_markers(text), R.abbreviation_rule(list(words)))
    t = X.enum_mask(t)
    t = X.rep(t, *R.PARAGRAPH_RULE)
    t = X.rx(t, R.BOUNDARY_RULE)
    t = X.rx(t, R.COLLAPSE_RULE)
    t = f"trim({t}, {X.q(R.WS_CHARS + R.SENT_MARK)})"
    t = X.enum_unmask(t)
    return X.rep(t, R.ABBR_MARK, ".")


LEARNED_ABBREVIATIONS = f"""
forms AS (
  SELECT lang, CASE WHEN ends_with(word, '.') THEN left(word, length(word) - 1) ELSE word END AS form,
         count(*) FILTER (ends_with(word, '.')) AS n_stop, count(*) FILTER (NOT ends_with(word, '.')) AS n_plain
  FROM (SELECT lang, unnest(regexp_extract_all(text, {X.q(AB.WORD)})) AS word FROM documents) GROUP BY ALL
),
totals AS (SELECT lang, sum(n_stop)::DOUBLE AS stops, sum(n_stop + n_plain)::DOUBLE AS words FROM forms GROUP BY lang),
types AS (
  SELECT lang, lower(form) AS type, sum(n_stop)::BIGINT AS n_stop, sum(n_plain)::BIGINT AS n_plain,
         list_sort(list(form) FILTER (n_stop > 0)) AS forms, length(replace(lower(form), '.', ''))::DOUBLE AS letters
  FROM forms GROUP BY lang, lower(form)
),
scored AS (
  SELECT t.*, 2 * (n_stop * (ln({AB.STOP_PROBABILITY}::DOUBLE) - ln(stops / words)) + n_plain * (ln(1 - {AB.STOP_PROBABILITY}::DOUBLE) - ln(1 - stops / words)))
         * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_plain::DOUBLE) AS score
  FROM types t JOIN totals USING (lang) WHERE n_stop > 0 AND stops < words
),
learned AS (SELECT * FROM scored WHERE score >= {AB.THRESHOLD})"""


@oracle("abbreviations")
def _():
    return f"WITH {LEARNED_ABBREVIATIONS.strip()}\nSELECT lang, type, n_stop, n_plain, round(score, 6) AS score, array_to_string(forms, '|') AS forms FROM learned"


@oracle("sentences_learned")
def _():
    marked = X.mark_sentences("text", "d.lang", learned="abbr_pattern")
    return f"""WITH {LEARNED_ABBREVIATIONS.strip()},
each_form AS (SELECT lang, unnest(forms) AS form FROM learned),
patterns AS (
  SELECT lang, '(^|[^\\p{{L}}])(' || string_agg(replace(form, '.', '\\.'), '|' ORDER BY length(form) DESC, form) || ')\\.' AS abbr_pattern
  FROM each_form GROUP BY lang
),
marked AS (SELECT doc_id, {marked} AS marked FROM documents d LEFT JOIN patterns p ON d.lang = p.lang),
s AS (SELECT doc_id, {X.sentence_array('marked')} AS sents FROM marked)
SELECT doc_id, (i - 1)::BIGINT AS sent_idx, sents[i] AS sent FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS i FROM s)"""


@oracle("sentences_abbrev")
def _():
    s = X.sentence_array(_marked_all_langs("text"))
    return f"""
SELECT doc_id, sent_idx::BIGINT AS sent_idx, sent FROM (
  SELECT doc_id, unnest(range(0, len(s))) AS sent_idx, unnest(s) AS sent
  FROM (SELECT doc_id, {s} AS s FROM documents)
)"""


@oracle("ngram_overlap")
def _():
    cols = ", ".join(f"{c}::BIGINT AS {c}" for c in (
        "hits", "sys_total", "ref_total", "add_sys", "add_ref", "add_ok", "keep_sys", "keep_ref", "keep_ok",
        "del_sys", "del_ref", "del_ok"))
    return f"WITH {EVAL_STATS.strip()}\nSELECT system, split, pair_id, kind, n::BIGINT AS n, {cols} FROM st"


@oracle("novel_ngrams")
def _():
    parts = " UNION ALL ".join(
        f"SELECT pair_id, {n}::BIGINT AS n, len(list_distinct(gb{n})) - len(list_intersect(list_distinct(gb{n}), ga{n})) "
        f"AS novel, len(list_distinct(gb{n})) AS total FROM pg" for n in (1, 2, 3))
    grams = ", ".join(f"{X.ngrams('a', n, f'x{n}')} AS ga{n}, {X.ngrams('b', n, f'y{n}')} AS gb{n}" for n in (1, 2, 3))
    return (f"WITH {PAIR_TOKENS.strip()},\n"
            f"pc AS (SELECT pair_id, {X.clean_tokens('src')} AS a, {X.clean_tokens('tgt')} AS b FROM pt),\n"
            f"pg AS (SELECT pair_id, {grams} FROM pc)\n"
            f"SELECT pair_id, n, novel::BIGINT AS novel, total::BIGINT AS total FROM ({parts})")


@oracle("mask_labels")
def _():
    plab = _pad("labels", 128)
    return (f"WITH {encode_sql().strip()}\n"
            f"SELECT split, pair_id, array_to_string(list_transform({plab}, lambda y: CASE WHEN y = 0 THEN -100 ELSE y END), ' ') "
            f"AS labels, greatest(128 - len(labels), 0)::BIGINT AS n_ignored FROM enc")
