"""The queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import decontamination, fingerprints, hard_negatives, language_id, language_model, line_dedup, mixing, near_dups, quality, resampling, simhash, token_counts, toxicity
from vellumspark.llm.common import held_out, shared_dir, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a quarter of the ids (held_out) are never learned from, as for the other classifiers."""
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2))))
    return out.withColumn("held_out", held_out(4, 2))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run starts from an empty cache of its own, so its figures are those of a first run."""
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(4, 2)
    return language_id.identify(table(spark, sf_dir, "documents"), ~held, held)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), held_out(10, 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return toxicity.scores(docs.withColumn("held_out", held_out(4, 2)), model, "held_out")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0), kept_chars, kept_sha256 of the text that stays."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("removed_lines").isNull(), 0).otherwise(F.size("removed_lines")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ","), F.lit("")).alias("removed_lines"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        line_dedup.digest(F.col("text")).alias("kept_sha256"),
    )


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the positions of the first and the last copy to six places, to compare with SQL."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    last = F.when(F.size("positions") > 0, F.element_at("positions", -1))
    return mix.withColumns({"target": F.round("target", 6), "position": F.round("position", 6), "last_position": F.round(last, 6)}).drop("positions")


SOURCE_MIX_SQL = """
with r as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, md5(coalesce(text, '')) k from documents),
d as (select doc_id, source, k, max(size) size, count(*) m, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || k), 1, 15))::bigint rank from r group by doc_id, source, k),
s as (select source, sum(size * m)::bigint ss, row_number() over (order by source nulls last) n, count(*) over () k from d group by source),
w as (select *, (n - 1) % 3 + 1 weight, 3.0::double * ss::double cap, sum(ss) over ()::double total from s),
f as (select *, (total - coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by cap / weight, n rows between current row and unbounded following) level from w),
c as (select *, level * weight >= cap capped from f),
g as (select source, ss, case when capped then cap else weight * first_value(level) over (partition by capped order by cap / weight, n) end target,
             case when k > 1 then 0.5::double * (1 - 2 * (n - 1) / (k - 1)::double) else 0::double end tilt from c),
t as (select source, ss, target, round(tilt - round(coalesce(sum(target * tilt) over () / sum(target) over (), 0), 9), 9) tilt from g),
b as (select d.*, t.ss, t.target, t.tilt, round(t.target)::bigint budget, case when ss > 0 then round(t.target)::bigint // ss else 0 end rounds,
             coalesce(sum(size * m) over (partition by d.source order by rank, doc_id, d.k rows between unbounded preceding and 1 preceding), 0)::bigint st
      from d join t on d.source is not distinct from t.source),
e as (select *, greatest(0, least(size * m, budget - rounds * ss - st))::bigint whole from b),
x as (select e.*, whole // m + (i < whole % m)::int rest from e, lateral (select unnest(range(m)) i)),
m as (select *, least(rounds * size + rest, 3 * size)::bigint taken, rounds + (rest > 0)::int copies from x),
u as (select *, least(1.0::double, st::double / greatest(target, 1.0::double)) first_, least(1.0::double, (st + (copies - 1) * ss)::double / greatest(target, 1.0::double)) last_ from m)
select doc_id, size, ss as source_size, round(target, 6) as target, taken,
       round(case when taken > 0 then (case when abs(tilt) < 1e-9 then first_
         else (1 + tilt - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * first_, 0))) / (2 * tilt) end) end, 6) + 0.0::double as position,
       round(case when taken > 0 then (case when abs(tilt) < 1e-9 then last_
         else (1 + tilt - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * last_, 0))) / (2 * tilt) end) end, 6) + 0.0::double as last_position, source
from u
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


IMPORTANCE_SQL = r"""
with recursive crc(n, c, k) as (
  select range::bigint, range::bigint, 0 from range(256)
  union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
steps as (select list(c order by n) step from crc where k = 8),
words as (select doc_id, lower_words(text) w from documents),
bench as (select unnest(lower_words(text)) w from benchmark),
vocabulary as (select distinct w from (select unnest(w) w from words union all select w from bench)),
bytes as (select w, list_transform(range(1, length(hex(w)), 2), lambda i: ('0x' || substr(hex(w), i, 2))::bigint) b from vocabulary),
bucket as (select w, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1])), 4294967295::bigint) % 10000 bucket from bytes, steps),
feature as (select doc_id, unnest(w) w from words),
s as (select bucket, count(*) s from feature join bucket using (w) group by bucket),
t as (select bucket, count(*) t from bench join bucket using (w) group by bucket),
gain as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double
                                 / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint gain
  from s full join t using (bucket)),
each as (select doc_id, count(*) n, sum(gain)::bigint total from feature join bucket using (w) join gain using (bucket) group by doc_id),
weighed as (
  select d.doc_id, coalesce(n, 0)::bigint n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint noise
  from documents d left join each using (doc_id)),
scored as (select doc_id, n_features, weight, weight + noise score from weighed),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when r <= n * 10 // 100 then r end as rank from scored left join ranked using (doc_id)
""".replace("lower_words(text)", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels move on by one where vec_id is divisible by 7."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


HARD_NEGATIVES_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, other_id positive_id, score positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from positives p join scores s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_bits(F.col("bits")).alias("fingerprint"), "component_id", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality, op2_token_counts, op3_fingerprints, op4_language_id, op5_language_model, op6_toxicity, op7_line_dedup, op8_near_dups, op9_source_mix, op10_decontamination, op11_importance, op12_hard_negatives, op13_simhash]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": SOURCE_MIX_SQL, "op11_importance": IMPORTANCE_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
