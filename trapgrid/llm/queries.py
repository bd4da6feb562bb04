"""One registered query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapgrid.llm import (
    byte_bpe,
    decontaminate,
    hard_negatives,
    language_id,
    near_dedup,
    packing,
    quality,
    secret_scan,
    suffix_dedup,
    token_output,
    toxicity,
    url_filter,
    vector_codes,
)
from trapgrid.llm.frames import stored

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def fold(of: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def op1_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed_pieces(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_best_fit_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_matrix(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.with_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rated.select("doc_id", *[f"quality.{c}" for c in facts])


def op5_prefix_doubling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.with_language(docs.select("doc_id", "text"), docs.where(fold(5) != 0))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op7_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marks = read(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    labelled = toxicity.labelled_texts(docs, marks.where(fold(4) != 2))
    rated = toxicity.with_toxicity(docs, labelled, docs.select("text"), "score")
    return rated.select("doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_random_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "start", "length", F.sha2(F.col("found").cast("binary"), 256).alias("found_sha256"), "probability", "is_secret")


def op10_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        decontaminate.hit_words("hits").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated("hits").alias("contaminated"),
    )


def op11_dual_tree_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.with_codes(read(spark, sf_dir, "embeddings"))
    code = vector_codes.code_text("codes.entry").alias("code")
    coded = vector_codes.with_label_error(stored(coded.select("vec_id", "label", code, "codes.error"), "vector-codes"), "error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256"))


def op12_segment_tree_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    encoded = byte_bpe.with_token_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    both = byte_bpe.with_decoded(encoded.select("doc_id", "ids"), ranks)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_cover_tree_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_language_model": op1_url_language_model,
        "op2_cost_balanced_packing": op2_cost_balanced_packing,
        "op3_best_fit_token_matrix": op3_best_fit_token_matrix,
        "op4_line_first_quality": op4_line_first_quality,
        "op5_prefix_doubling_repeats": op5_prefix_doubling_repeats,
        "op6_naive_bayes_language": op6_naive_bayes_language,
        "op7_chosen_path_near_duplicates": op7_chosen_path_near_duplicates,
        "op8_noisy_channel_toxicity": op8_noisy_channel_toxicity,
        "op9_random_forest_secrets": op9_random_forest_secrets,
        "op10_benchmark_automaton": op10_benchmark_automaton,
        "op11_dual_tree_vector_codes": op11_dual_tree_vector_codes,
        "op12_segment_tree_byte_bpe": op12_segment_tree_byte_bpe,
        "op13_cover_tree_hard_negatives": op13_cover_tree_hard_negatives,
    }


_SPACES = r"[ \t\n\x0B\f\r]+"
_LINE = r"""
  (10 * (length(regexp_replace(l, '{sp}', '', 'g')) - length(regexp_replace(regexp_replace(l, '{sp}', '', 'g'), '[#*$%&|<>{{}}\[\]^~=_\\/@+!?]', '', 'g')))
     > 2 * length(regexp_replace(l, '{sp}', '', 'g'))
   or regexp_matches(l, '(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|contact us|about us|next|previous|back to top|share|tweet|read more)\W*$')
   or len(regexp_split_to_array(l, ' [|»·>] ')) > 4
   or (length(l) < 200 and regexp_matches(l, '(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|(released|licensed) under|is licensed under|click here|subscribe to our)')))"""

#: Windows of three words are counted per document, lines judged one by one.
_QUALITY_SQL = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
words as (select r, list_filter(regexp_split_to_array(t, '{_SPACES}'), lambda w: w <> '') as ws from docs),
win as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c
  from (select r, ws, unnest(generate_series(1, len(ws) - 2)) as i from words)),
often as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from win) where n > 1),
rep as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from often) group by r),
lines as (select r, unnest(string_split(t, chr(10))) as l from docs),
dup as (select r, count(*) - count(distinct l) as n from lines where regexp_matches(l, '[^ \t\n\x0B\f\r]') group by r),
gone as (select r, sum(length(regexp_replace(l, '{_SPACES}', '', 'g'))) as n from lines where {_LINE.format(sp=_SPACES)} group by r),
facts as (select doc_id, len(ws) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as bigint) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as removed
  from docs join words using (r) left join dup using (r) left join rep using (r) left join gone using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * removed <= word_chars as kept
from facts"""

#: A window of an item against the windows of the same length of each document.
_HITS_SQL = r"""
with norm as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from documents),
items as (select coalesce(cast(item_id as varchar), 'null') as item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from benchmark),
wins as (select distinct item, least(13, len(ws)) as k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as w
  from (select item, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) as i from items where len(ws) > 0)),
found as (select r, k, i, item from (select r, k, i, array_to_string(ws[i:i + k - 1], ' ') as w
    from (select r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as i from norm, (select distinct k from wins))) p join wins using (k, w)),
hit as (select r, count(distinct p) as n from (select r, unnest(generate_series(i, i + k - 1)) as p from found) group by r),
own as (select r, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct r, item from found) group by r)
select doc_id, len(ws) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(own.n, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(ws) as contaminated
from norm left join hit using (r) left join own using (r)"""


_KEPT_SQL = """
kept as (select row_number() over (order by vec_id nulls last, ints) as r, vec_id, label, ints
  from (select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as ints, embedding from {table})
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0{more})"""

#: Lloyd's rounds one after the other: nearest entries by exact squared distances, then means rounded down.
_CODES_SQL = (
    "with " + _KEPT_SQL.format(scale=4096, table="embeddings", more="") + """,
parts as (select r, p, ints[(p - 1) * (len(ints) // 8) + 1:p * (len(ints) // 8)] as v from kept, range(1, 9) t(p)),
book0 as (select p, r - 1 as e, v from parts where r <= 16)"""
    + "".join(
        f""",
near{k} as (select r, p, v, arg_min(e, (d, e)) as e, min(d) as d from (
    select r, a.p, a.v, b.e, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
    from parts a join book{k} b on a.p = b.p) group by r, p, v)"""
        + (
            ""
            if k == 6
            else f""",
mean{k} as (select p, e, list(m order by i) as v from (
    select p, e, i, cast(floor(sum(x) / count(*)) as bigint) as m
    from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from near{k}) group by p, e, i) group by p, e),
book{k + 1} as (select b.p, b.e, coalesce(m.v, b.v) as v from book{k} b left join mean{k} m on b.p = m.p and b.e = m.e)"""
        )
        for k in range(7)
    )
    + """,
coded as (select r, string_agg(lpad(printf('%x', e), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from near6 group by r),
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from book6)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (r), digest"""
)

#: All rows against each anchor, then each of the anchor's positives.
_NEGATIVES_SQL = (
    "with moved as (select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from embeddings),"
    + _KEPT_SQL.format(scale=256, table="moved", more=" and label is not null and vec_id is not null")
    + """,
vecs as (select r, vec_id, label, cast(ints as double[]) as v from kept),
scored as (select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from vecs a join vecs b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select r, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, vec_id) as k from scored where same),
neg as (select p.r, p.k, p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by p.r, p.k order by s.score desc, s.vec_id) as integer) as rank
  from pos p join scored s on p.r = s.r and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score where p.k <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from neg where rank <= 5"""
)


def llm_oracles() -> dict[str, str]:
    return {"op4_line_first_quality": _QUALITY_SQL, "op10_benchmark_automaton": _HITS_SQL, "op11_dual_tree_vector_codes": _CODES_SQL, "op13_cover_tree_hard_negatives": _NEGATIVES_SQL}
