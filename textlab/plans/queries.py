"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables (or data Spark derives from them) in
full.  Doubles are rounded to 6 decimals and counts cast to BIGINT so that
results compare with the DuckDB oracle (:mod:`textlab.plans.oracle`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as RULES
from ..functions import text as T
from ..operators import abbreviations as AB
from ..operators import lemma_rules as LR
from ..operators import encode as ENC
from ..operators import evaluation as EV
from ..operators import lcs as LCS
from ..operators import sections as SEC
from ..operators import segment as S
from ..operators import stats as A
from ..session import materialize
from ..sources import files as IO
from ..sources import lexicon
from ..sources import line_index as LI
from ..sources import tables as src
from . import corpus_report as CR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- segmentation

@query("enum_mask")
def q_enum_mask(spark, sf):
    d = src.documents(spark, sf)
    m = T.enum_mask("text")
    return d.select("doc_id", m.alias("masked"), (T.enum_unmask(m) == F.col("text")).alias("roundtrip"))


@query("paragraphs")
def q_paragraphs(spark, sf):
    return S.paragraphs(src.documents(spark, sf)).select(
        "doc_id", F.col("para_idx").cast("bigint").alias("para_idx"), "paragraph")


@query("sentences")
def q_sentences(spark, sf):
    return S.sentences(src.documents(spark, sf)).select(
        "doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sent")


@query("eval_sentences")
def q_eval_sentences(spark, sf):
    d = src.documents(spark, sf)
    s = T.sentence_array(T.plain_marked_sentences("text"))
    return T.explode_rows(d, s, "sent", "sent_idx", keep=("doc_id",)).select(
        "doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sent")


@query("tokens")
def q_tokens(spark, sf):
    return S.tokens(src.documents(spark, sf)).select(
        "doc_id",
        F.col("sent_idx").cast("bigint").alias("sent_idx"),
        F.col("tok_idx").cast("bigint").alias("tok_idx"),
        "token",
    )


@query("eval_tokens")
def q_eval_tokens(spark, sf):
    """Per-document tokens with the default (enumeration-free) split."""
    d = src.documents(spark, sf)
    toks = T.token_array(T.plain_marked_sentences("text"))
    return T.explode_rows(d, toks, "token", "tok_idx", keep=("doc_id",)).select(
        "doc_id", F.col("tok_idx").cast("bigint").alias("tok_idx"), "token")


@query("newline_sentences")
def q_newline_sentences(spark, sf):
    """Sentences joined by newlines (the ROUGE-Lsum input)."""
    d = src.documents(spark, sf)
    s = T.sentence_array(T.plain_marked_sentences("text"))
    return d.select("doc_id", F.array_join(s, "\n").alias("text_nl"), F.size(s).cast("bigint").alias("n_sents"))


@query("lemmas")
def q_lemmas(spark, sf):
    d = src.documents(spark, sf)
    out = S.lemmas(d, lexicon.builtin_lemmas(spark))
    return out.select(
        "doc_id",
        F.col("sent_idx").cast("bigint").alias("sent_idx"),
        F.col("tok_idx").cast("bigint").alias("tok_idx"),
        "token",
        "lemma",
    )


@query("lemma_rules")
def q_lemma_rules(spark, sf):
    """Types of the corpus that the dictionary lacks, with the lemma that its suffix rules give."""
    types = S.tokens(src.documents(spark, sf), keep=("doc_id", "lang")).select("lang", "token").distinct()
    entries = lexicon.builtin_lemmas(spark)
    unknown = types.join(entries, ["lang", "token"], "left_anti")
    return LR.guess(unknown, LR.learn(entries, support=1)).select("lang", "token", "lemma", "suffix")


@query("lemmas_guessed")
def q_lemmas_guessed(spark, sf):
    """Lemmas by the dictionary and, for words it lacks, by its suffix rules."""
    d = src.documents(spark, sf)
    types = S.tokens(d, keep=("doc_id", "lang")).select("lang", "token").distinct()
    # written once: the join with all tokens then knows its size
    out = S.lemmas(d, materialize(LR.extended(types, lexicon.builtin_lemmas(spark), support=1), "lemma-dictionary"))
    return out.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.col("tok_idx").cast("bigint").alias("tok_idx"), "token", "lemma")


# ---------------------------------------------------------------- vocabulary

@query("vocab")
def q_vocab(spark, sf):
    return A.vocab(src.documents(spark, sf), by=("lang",), clean=True)


@query("vocab_raw")
def q_vocab_raw(spark, sf):
    return A.vocab(src.documents(spark, sf), by=("lang",), clean=False)


@query("clean_tokens")
def q_clean_tokens(spark, sf):
    d = S.with_arrays(src.documents(spark, sf))
    toks = T.explode_rows(d, "toks", "token").distinct()
    return toks.select("token", T.clean_token("token").alias("cleaned"))


# ---------------------------------------------------------------- statistics

def _doc_stats_cols():
    return [
        "doc_id", "lang", "n_tokens", "n_sents",
        r6(F.col("avg_token_len")).alias("avg_token_len"),
        r6(F.col("avg_sent_len")).alias("avg_sent_len"),
        r6(F.col("ttr")).alias("ttr"),
        r6(F.col("fre")).alias("fre"),
    ]


@query("doc_stats")
def q_doc_stats(spark, sf):
    return A.doc_table(src.documents(spark, sf)).select(*_doc_stats_cols())


@query("doc_stats_lemmas")
def q_doc_stats_lemmas(spark, sf):
    return A.doc_table(src.documents(spark, sf), lexicon.builtin_lemmas(spark)).select(*_doc_stats_cols())


@query("flesch")
def q_flesch(spark, sf):
    t = A.doc_table(src.documents(spark, sf))
    return t.select("doc_id", "lang", r6(F.col("fre")).alias("fre"))


def _corpus_cols(by):
    return [
        *by, "docs", "tokens", "sentences", "types_raw", "types_lemmas",
        *[r6(F.col(c)).alias(c) for c in
          ("avg_words", "avg_sents", "avg_ttr", "avg_fre", "avg_word_len", "avg_sent_len")],
    ]


@query("corpus_stats")
def q_corpus_stats(spark, sf):
    t = A.doc_table(src.documents(spark, sf), lexicon.builtin_lemmas(spark))
    return A.corpus_stats(t, ["lang"]).select(*_corpus_cols(["lang"]))


@query("type_counts")
def q_type_counts(spark, sf):
    t = A.doc_table(src.documents(spark, sf), lexicon.builtin_lemmas(spark))
    return A.type_counts(t, ["lang"]).select(
        "lang", F.col("types_raw").cast("bigint").alias("types_raw"),
        F.col("types_lemmas").cast("bigint").alias("types_lemmas"))


@query("type_counts_approx")
def q_type_counts_approx(spark, sf):
    """A2: sketches of (split, lang) slices merged by language, held against the exact counts."""
    t = A.doc_table(src.documents(spark, sf), lexicon.builtin_lemmas(spark)).select("doc_id", "lang", "types", "lemma_types")
    t = materialize(t, "doc-types")  # sketches and exact counts read it: texts are tokenised once
    slices = materialize(A.type_sketches(t.withColumn("split", src.split_of(F.col("doc_id"))), ["split", "lang"]), "type-sketches")
    about = A.merge_type_sketches(slices, ["lang"]).select("lang", F.col("types_raw").alias("about_raw"), F.col("types_lemmas").alias("about_lemmas"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.ceil(F.col(b) * A.SKETCH_ERROR)
    return A.type_counts(t, ["lang"]).join(about, "lang").select(
        "lang", F.col("types_raw").cast("bigint").alias("types_raw"), F.col("types_lemmas").cast("bigint").alias("types_lemmas"),
        near("about_raw", "types_raw").alias("raw_within_bound"), near("about_lemmas", "types_lemmas").alias("lemmas_within_bound"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# ---------------------------------------------------------------- pairs, novelty, report


@query("paired_corpus")
def q_paired_corpus(spark, sf):
    return src.conversation_pairs(spark, sf)


@query("ngrams")
def q_ngrams(spark, sf):
    d = S.with_arrays(src.documents(spark, sf)).select("doc_id", "toks")
    per_n = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("n"), T.ngrams("toks", n).alias("g")) for n in (1, 2, 3)
    ])
    x = d.select("doc_id", F.inline(per_n))
    return x.select(
        "doc_id", "n",
        F.size("g").cast("bigint").alias("n_grams"),
        F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"),
    )


def _pair_tokens(spark, sf):
    p = src.conversation_pairs(spark, sf)
    return p.select(
        "pair_id",
        T.token_array(T.mark_sentences("source", F.lit("en"))).alias("src"),
        T.token_array(T.mark_sentences("target", F.lit("en"))).alias("tgt"),
    )


def _novelty_query(n):
    def fn(spark, sf):
        p = A.with_novelty(_pair_tokens(spark, sf), "src", "tgt", (n,))
        return p.select("pair_id", r6(F.col(f"nov_{n}")).alias("novelty"))
    return fn


for _n in (1, 2, 3):
    query(f"novelty_{_n}")(_novelty_query(_n))


@query("compression")
def q_compression(spark, sf):
    p = _pair_tokens(spark, sf)
    s, t = F.size("src").cast("bigint"), F.size("tgt").cast("bigint")
    return p.select("pair_id", s.alias("src_tokens"), t.alias("tgt_tokens"), r6(A.compression(s, t)).alias("cmp"))


def _report_cols(df):
    return df.select(F.col("ord").cast("bigint").alias("ord"), "statistic",
                     r6(F.col("source")).alias("source"), r6(F.col("target")).alias("target"))


@query("corpus_report")
def q_corpus_report(spark, sf):
    return _report_cols(CR.corpus_report(src.conversation_pairs(spark, sf), lexicon.builtin_lemmas(spark)))


@query("corpus_report_docs")
def q_corpus_report_docs(spark, sf):
    return _report_cols(CR.corpus_report(src.document_pairs(spark, sf), lexicon.builtin_lemmas(spark)))


@query("corpus_report_formatted")
def q_corpus_report_formatted(spark, sf):
    rep = materialize(CR.corpus_report(src.conversation_pairs(spark, sf), lexicon.builtin_lemmas(spark)), "report")
    return CR.format_report(rep).select(F.col("ord").cast("bigint").alias("ord"), "statistic", "Source", "Target")


@query("corpus_novelty")
def q_corpus_novelty(spark, sf):
    m = CR.corpus_novelty(src.conversation_pairs(spark, sf), lexicon.builtin_lemmas(spark))
    return m.select(*[r6(F.col(f"nov_{n}")).alias(f"nov_{n}") for n in (1, 2, 3)], "novelty")


# ---------------------------------------------------------------- evaluation


REPORT_METRICS = ["R-1", "R-2", "BLEU", "SARI", "|y|_w", "CMP_w", "Nov. (n=1)", "Nov. (n=2)"]


def _eval(spark, sf) -> EV.Eval:
    """The conversation pairs with the outputs of the stand-in systems."""
    return EV.Eval(src.stand_in_outputs(src.conversation_pairs(spark, sf)), src.STAND_IN_SYSTEMS)


def _rouge(n):
    def fn(spark, sf):
        r = EV.rouge_n(_eval(spark, sf).clustered(), n)
        return r.select("system", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "fmeasure")])
    return fn


query("rouge_1")(_rouge(1))
query("rouge_2")(_rouge(2))


@query("bleu")
def q_bleu(spark, sf):
    return EV.bleu(_eval(spark, sf).clustered()).select("system", r6(F.col("bleu")).alias("bleu"))


@query("sari")
def q_sari(spark, sf):
    s = EV.sari(_eval(spark, sf).clustered())
    return s.select("system", *[r6(F.col(c)).alias(c) for c in ("sari_add", "sari_keep", "sari_del", "sari")])


@query("surface_stats")
def q_surface_stats(spark, sf):
    s = EV.surface_stats(_eval(spark, sf).clustered())
    return s.select("system", *[r6(F.col(c)).alias(c)
                                for c in ("x_w", "x_s", "y_w", "y_s", "cmp_w", "cmp_s", "nov_1", "nov_2")])


@query("metric_means")
def q_metric_means(spark, sf):
    m = EV.metric_table(_eval(spark, sf))
    return m.select("system", "metric", r6(F.col("value")).alias("value"))


@query("metric_report")
def q_metric_report(spark, sf):
    return EV.metric_report(EV.metric_table(_eval(spark, sf)), REPORT_METRICS, precision=2)


# ---------------------------------------------------------------- sections, clean-up


@query("sections")
def q_sections(spark, sf):
    return SEC.sections(src.documents(spark, sf))


@query("sections_preamble")
def q_sections_preamble(spark, sf):
    s = SEC.sections(src.documents(spark, sf))
    return s.where(F.col("title_start").isNull())


@query("next_section")
def q_next_section(spark, sf):
    return SEC.next_section(src.documents(spark, sf))


@query("strip_text")
def q_strip_text(spark, sf):
    c = src.read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.strip("text").alias("stripped"),
                    F.length(T.strip("text")).cast("bigint").alias("n_chars"))


@query("text_cleanup")
def q_text_cleanup(spark, sf):
    """N5 on detokenised-looking text: the T6 tokens of each document joined
    by spaces, then the clean-up rules."""
    d = S.with_arrays(src.documents(spark, sf)).select("doc_id", F.array_join("toks", " ").alias("spaced"))
    return d.select("doc_id", T.tokenization_cleanup("spaced").alias("cleaned"))


# ---------------------------------------------------------------- training-data preparation


PREFIX = "simplify: "


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


def _enc_inputs(spark, sf, prefix=""):
    pairs = src.conversation_pairs(spark, sf)
    toks = ENC.pair_tokens(pairs, prefix=prefix)
    return toks, materialize(ENC.vocab_ids(toks), "vocab")


@query("prefix_source")
def q_prefix_source(spark, sf):
    p = src.conversation_pairs(spark, sf)
    return p.select("pair_id", F.concat(F.lit(PREFIX), F.col("source")).alias("prefixed"))


@query("first_n")
def q_first_n(spark, sf):
    return ENC.first_n(src.conversation_pairs(spark, sf), 10).select("split", "pair_id", "source", "target")


@query("vocab_ids")
def q_vocab_ids(spark, sf):
    _, v = _enc_inputs(spark, sf)
    return v.select("token", "id", "cnt")


@query("encode_pairs")
def q_encode_pairs(spark, sf):
    toks, v = _enc_inputs(spark, sf, PREFIX)
    e = ENC.encode(toks, v, max_source_length=1024, max_target_length=128, val_max_target_length=64)
    return e.select("split", "pair_id", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"),
                    F.size("input_ids").cast("bigint").alias("n_input"), F.size("labels").cast("bigint").alias("n_labels"))


@query("pad_pairs")
def q_pad_pairs(spark, sf):
    toks, v = _enc_inputs(spark, sf)
    e = ENC.pad_pairs(ENC.encode(toks, v, 256, 128), 256, 128, ignore_pad_token_for_loss=True)
    return e.select("split", "pair_id", _ids_str("input_ids").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_attended"),
                    _ids_str("labels").alias("labels"))


@query("decode_ids")
def q_decode_ids(spark, sf):
    toks, v = _enc_inputs(spark, sf)
    e = ENC.encode(toks, v, 1024, 128)
    return ENC.decode(e, "input_ids", v).select("split", "pair_id", "text")


@query("gen_len")
def q_gen_len(spark, sf):
    toks, v = _enc_inputs(spark, sf)
    e = ENC.pad_pairs(ENC.encode(toks, v, 1024, 128), 1024, 128, ignore_pad_token_for_loss=False)
    return ENC.gen_len(e, "labels", by=["split"]).select("split", r6(F.col("gen_len")).alias("gen_len"))


# ---------------------------------------------------------------- sources and sinks


def _doc_lines(spark, sf):
    """Write the documents as a line file (doc_id order) and read it back."""
    path = IO.scratch(spark, "doc-lines")
    IO.write_lines(src.read_table(spark, sf, "documents"), path, "text", "doc_id")
    return IO.read_lines(spark, path)


@query("read_lines")
def q_read_lines(spark, sf):
    return _doc_lines(spark, sf).select("line_no", "line")


@query("pair_lines")
def q_pair_lines(spark, sf):
    """A source file and a target file with fewer lines (every tenth
    document has no target), paired by position with truncation."""
    src_lines = _doc_lines(spark, sf)
    tgt_path = IO.scratch(spark, "tgt-lines")
    tgt = src.document_pairs(spark, sf).where(F.pmod("pair_id", F.lit(10)) != 9)
    IO.write_lines(tgt, tgt_path, "target", "pair_id")
    return IO.pair_lines(src_lines, IO.read_lines(spark, tgt_path))


@query("read_lines_indexed")
def q_read_lines_indexed(spark, sf):
    """S1 by the line index: one scan of the text, no join."""
    path = IO.scratch(spark, "doc-lines")
    IO.write_lines(src.read_table(spark, sf, "documents"), path, "text", "doc_id")
    return LI.read_indexed(spark, LI.index_lines(spark, path))


def _split_line_files(spark, sf):
    """The pairs as line files {split}.source and {split}.target."""
    pairs = materialize(src.conversation_pairs(spark, sf), "pairs")
    base = IO.scratch(spark, "line-splits")
    for split in IO.SPLITS:
        part = pairs.where(F.col("split") == split)
        for side in ("source", "target"):
            IO.write_lines(part, f"{base}/{split}.{side}", side, "pair_id")
    return base


@query("convert_splits")
def q_convert_splits(spark, sf):
    """The line files of three splits converted to JSON lines and read back."""
    base = _split_line_files(spark, sf)
    IO.convert_splits(spark, {s: f"{base}/{s}.source" for s in IO.SPLITS}, {s: f"{base}/{s}.target" for s in IO.SPLITS}, f"{base}/json")
    line_no = IO.Ty.StructType([IO.Ty.StructField("pair_id", IO.Ty.LongType(), True)])
    back = IO.read_splits(spark, {s: f"{base}/json/{s}.json" for s in IO.SPLITS}, line_no)
    return back.select("split", F.col("pair_id").alias("line_no"), "source", "target")


_PAIR_ID = IO.Ty.StructType([IO.Ty.StructField("pair_id", IO.Ty.LongType(), True)])


@query("jsonl_roundtrip")
def q_jsonl_roundtrip(spark, sf):
    """S3: pairs written as JSON lines, read back with an explicit schema."""
    path = IO.scratch(spark, "jsonl")
    IO.write_jsonl(src.conversation_pairs(spark, sf), path)
    fields = IO.Ty.StructType([IO.Ty.StructField("split", IO.Ty.StringType(), True), *_PAIR_ID.fields])
    return IO.read_jsonl(spark, path, fields).select("split", "pair_id", "source", "target")


@query("corpus_union")
def q_corpus_union(spark, sf):
    """The three split files read by name and concatenated."""
    path = IO.scratch(spark, "splits")
    pairs = src.conversation_pairs(spark, sf)
    for split in IO.SPLITS:
        IO.write_jsonl(pairs.where(F.col("split") == split).drop("split"), f"{path}/{split}.jsonl")
    out = IO.read_splits(spark, {s: f"{path}/{s}.jsonl" for s in IO.SPLITS}, _PAIR_ID)
    return out.select("split", "pair_id", "source", "target")


def _written_runs(spark, sf):
    """Line files of the originals, references and the stand-in systems' predictions, one folder per system."""
    ev = materialize(src.stand_in_outputs(src.conversation_pairs(spark, sf)), "outputs")
    base = IO.scratch(spark, "runs")
    for name, col in [("orig", "orig"), ("refs", "ref"), *[(n, f"y{i}") for i, n in enumerate(src.STAND_IN_SYSTEMS)]]:
        IO.write_lines(ev, f"{base}/{name}/predictions_test.txt", col, "pair_id")
    return base


def _run_paths(base):
    return [f"{base}/{s}/predictions_test.txt" for s in src.STAND_IN_SYSTEMS]


def _eval_from_files(spark, sf) -> EV.Eval:
    base = _written_runs(spark, sf)
    return IO.eval_files(spark, f"{base}/orig/predictions_test.txt", f"{base}/refs/predictions_test.txt", _run_paths(base))


@query("load_runs")
def q_load_runs(spark, sf):
    return IO.load_runs(spark, _run_paths(_written_runs(spark, sf)))


@query("alignment_check")
def q_alignment_check(spark, sf):
    """S8 on the written files, with one run that lacks the last fifth of its lines."""
    base = _written_runs(spark, sf)
    short = src.stand_in_outputs(src.conversation_pairs(spark, sf)).where(F.pmod("pair_id", F.lit(5)) != 0)
    IO.write_lines(short, f"{base}/short/predictions_test.txt", "y0", "pair_id")
    runs = IO.load_runs(spark, [*_run_paths(base), f"{base}/short/predictions_test.txt"])
    lines = [IO.read_lines(spark, f"{base}/{n}/predictions_test.txt") for n in ("orig", "refs")]
    return IO.alignment_counts(*lines, runs)


@query("eval_table")
def q_eval_table(spark, sf):
    """Originals, references and runs read from files and joined by line."""
    return _eval_from_files(spark, sf).long().select("system", F.col("pair_id").alias("line_no"), "orig", "ref", "sys")


@query("eval_table_indexed")
def q_eval_table_indexed(spark, sf):
    """S7, S8, J2 by line indexes: totals from the indexes, each file read once."""
    base = _written_runs(spark, sf)
    orig, ref = (LI.index_lines(spark, f"{base}/{n}/predictions_test.txt") for n in ("orig", "refs"))
    ev = LI.eval_indexed(spark, orig, ref, LI.load_runs_indexed(spark, _run_paths(base)))
    return ev.long().select("system", F.col("pair_id").alias("line_no"), "orig", "ref", "sys")


@query("clean_predictions")
def q_clean_predictions(spark, sf):
    """S9 + N5: the outputs of all systems stripped, cleaned, written one per line, read back."""
    ev = materialize(src.stand_in_outputs(src.conversation_pairs(spark, sf)), "outputs")
    base = IO.scratch(spark, "predictions")
    for i, name in enumerate(src.STAND_IN_SYSTEMS):
        IO.write_lines(ev.select("pair_id", T.tokenization_cleanup(T.strip(f"y{i}")).alias("pred")), f"{base}/{name}/predictions_test.txt", "pred", "pair_id")
    return IO.load_runs(spark, _run_paths(base)).select("system", "line_no", F.col("sys").alias("line"))


# ---------------------------------------------------------------- ROUGE-Lsum, full evaluation, nested view


@query("rouge_lsum")
def q_rouge_lsum(spark, sf):
    r = LCS.rouge_lsum(_eval(spark, sf).clustered())
    return r.select("system", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "fmeasure")])


@query("evaluate_runs")
def q_evaluate_runs(spark, sf):
    """All 19 metrics for every run, read from files, in one job (long form)."""
    m = EV.metric_table(_eval_from_files(spark, sf), with_lsum=True)
    return m.select("system", "metric", r6(F.col("value")).alias("value"))


@query("document_table")
def q_document_table(spark, sf):
    """T11 nested view, flattened for comparison: sentences joined by a
    separator, tokens and lemmas joined by spaces within a sentence."""
    d = S.document_table(src.documents(spark, sf, clustered=True), lexicon.builtin_lemmas(spark))
    sep = "\u0001"
    return d.select(
        "doc_id",
        F.size("sents").cast("bigint").alias("n_sents"),
        F.array_join("sents", sep).alias("sents"),
        F.array_join(F.transform("sents_tokenized", lambda s: F.array_join(s, " ")), sep).alias("tokens"),
        F.array_join(F.transform("sents_lemmatized", lambda s: F.array_join(s, " ")), sep).alias("lemmas"),
    )


@query("encoded_sample")
def q_encoded_sample(spark, sf):
    """The first training row, encoded and decoded, written as JSON.  Only that row is encoded."""
    toks, v = _enc_inputs(spark, sf)
    first = toks.where(F.col("split") == "train").orderBy("pair_id").limit(1)
    e = ENC.encode(first, v, 1024, 128)
    row = e.join(ENC.decode(e, "input_ids", v, out="input_tokens"), ["split", "pair_id"]).join(
        ENC.decode(e, "labels", v, out="labels_tokens"), ["split", "pair_id"])
    path = IO.scratch(spark, "batch-sample")
    row.write.mode("overwrite").json(path)
    back = spark.read.schema(row.schema).json(path)
    return back.select("pair_id", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"),
                       "input_tokens", "labels_tokens")


@query("saved_metrics")
def q_saved_metrics(spark, sf):
    """Metric rows and the number of samples saved twice under one key, as a rerun does, and read back."""
    path = IO.scratch(spark, "metrics")
    ev = _eval(spark, sf)
    metrics, samples = materialize(EV.metric_table(ev), "metric-table"), ev.rows.count()
    for _ in range(2):
        IO.save_metrics(metrics, path, "test", samples=samples)
    return IO.read_metrics(spark, path).select("prefix", "system", "metric", r6(F.col("value")).alias("value"))


TRAINING_METRICS = ["R-1", "R-1_p", "R-1_r", "R-2", "R-2_p", "R-2_r", "R-L", "R-L_p", "R-L_r", "BLEU", "SARI"]
PREDICTED_TOKENS = 40


@query("decoded_metrics")
def q_decoded_metrics(spark, sf):
    """The 12 training-time values on decoded ids (the first
    PREDICTED_TOKENS input ids stand in for generated ones), rounded to 4."""
    toks, v = _enc_inputs(spark, sf)
    e = materialize(ENC.encode(toks, v, 1024, 128).withColumn("pred_ids", F.slice("input_ids", 1, PREDICTED_TOKENS)), "encoded")
    texts = [ENC.decode(e, ids, v, out=out) for ids, out in (("input_ids", "orig"), ("labels", "ref"), ("pred_ids", "y0"))]
    rows = materialize(texts[0].join(texts[1], ["split", "pair_id"]).join(texts[2], ["split", "pair_id"]), "decoded-eval")
    m = EV.metric_table(EV.Eval(rows, ("decoded",)), with_lsum=True, surface=False).where(F.col("metric").isin(TRAINING_METRICS))
    g = ENC.gen_len(e, "pred_ids").select(F.lit("decoded").alias("system"), F.lit("gen_len").alias("metric"), F.col("gen_len").alias("value"))
    return m.unionByName(g).select("system", "metric", T.round_exact("value", 4).alias("value"))


# ---------------------------------------------------------------- further inventory keys


@query("abbreviations")
def q_abbreviations(spark, sf):
    """T5: abbreviations of each language, learned from all documents."""
    learned = AB.learn(src.documents(spark, sf))
    return learned.select("lang", "type", "n_stop", "n_plain", r6(F.col("score")).alias("score"), F.array_join("forms", "|").alias("forms"))


@query("sentences_learned")
def q_sentences_learned(spark, sf):
    """T4/T5: sentences with the learned lists joined back by language."""
    docs = src.documents(spark, sf)
    return AB.sentences(docs, materialize(AB.learn(docs), "abbreviations")).select(
        "doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sent")


@query("sentences_abbrev")
def q_sentences_abbrev(spark, sf):
    """T5 as a parameter: the German abbreviation list applied to every
    document, whatever its language."""
    d = src.documents(spark, sf)
    abbr = {code: RULES.EXTRA_ABBREVIATIONS["de"] for code in ("de", "en", "fr", "es")}
    sents = T.sentence_array(T.mark_sentences("text", "lang", abbreviations=abbr))
    return T.explode_rows(d, sents, "sent", "sent_idx", keep=("doc_id",)).select(
        "doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sent")


@query("ngram_overlap")
def q_ngram_overlap(spark, sf):
    """Per (system, pair, kind, n) clipped overlap, totals and SARI parts."""
    ev = _eval(spark, sf).clustered()
    st = EV.pair_order_stats(EV.ngram_counts(ev), ev)
    cols = ["hits", "sys_total", "ref_total", "add_sys", "add_ref", "add_ok", "keep_sys", "keep_ref", "keep_ok",
            "del_sys", "del_ref", "del_ok"]
    return st.select("system", "split", "pair_id", "kind", F.col("n").cast("bigint").alias("n"),
                     *[F.col(c).cast("bigint").alias(c) for c in cols])


@query("novel_ngrams")
def q_novel_ngrams(spark, sf):
    """Per pair and n, distinct target n-grams absent from the source, and
    all distinct target n-grams (cleaned tokens)."""
    p = _pair_tokens(spark, sf).select("pair_id", T.clean_tokens("src").alias("a"), T.clean_tokens("tgt").alias("b"))
    per_n = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"),
                               F.array_distinct(T.ngrams("b", n)).alias("gb"), T.ngrams("a", n).alias("ga"))
                      for n in (1, 2, 3)])
    x = p.select("pair_id", F.inline(per_n))
    return x.select("pair_id", "n", F.size(F.array_except("gb", "ga")).cast("bigint").alias("novel"),
                    F.size("gb").cast("bigint").alias("total"))


@query("mask_labels")
def q_mask_labels(spark, sf):
    """E5: labels padded to 128 with padding replaced by -100."""
    toks, v = _enc_inputs(spark, sf)
    e = ENC.encode(toks, v, 1024, 128)
    masked = e.select("split", "pair_id", ENC.mask_labels(ENC.pad("labels", 128)).alias("labels"))
    return masked.select("split", "pair_id", _ids_str("labels").alias("labels"),
                         F.size(F.filter("labels", lambda x: x == ENC.IGNORE_ID)).cast("bigint").alias("n_ignored"))
