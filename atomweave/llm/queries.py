"""Queries of the operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, exact_dedup, language_id, media, packing, paragraphs, pieces, prefix_trie, quality, simhash, token_counts, token_files
from .common import bounded_batches


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_ids(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep_ids=False)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.CumulativeLink:
    return quality.fit(quality.graded(docs, table(spark, sf_dir, "labels")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality_model(spark, docs, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.substring_dedup(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(docs.where(~F.coalesce(held_out, F.lit(False))).select("text", "lang"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, smooth=5, scale=1_000_000_000, top=50)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = prefix_trie.ranked_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    rebuilt, members = prefix_trie.with_heads(ranked, base=conv - conv % 100, head=F.crc32(conv.cast("string").cast("binary")) % 6)
    trie = prefix_trie.prefix_trie(rebuilt, members)
    digest = F.coalesce("digest", F.lit(prefix_trie.NOTHING)).alias("ends_sha256")
    out = trie.nodes.join(prefix_trie.ends_digests(trie.ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), digest)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_lossless_webp, op3_sentencepiece, op4_quality_classifier, op5_substring_dedup,
        op6_language_id, op7_simhash, op8_token_files, op9_exact_dedup, op10_token_counts, op11_decontamination, op12_source_divergence, op13_prefix_trie, pipeline,
    )
}

ORACLE_SQL = {
    "op9_exact_dedup": r"""
with rows as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from rows
window w as (partition by norm order by length(t) desc, doc_id rows between unbounded preceding and unbounded following)
""",
    "op11_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), sized as (
  select item_id, w, least(10, len(w)) as k from b where len(w) > 0
), windows as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from sized)
), spots as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from windows) where len(w) >= k)
), hits as (
  select doc_id, i, k, item_id from spots join windows using (k, g)
), words as (
  select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hits) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, coalesce(cast(item_id as varchar), '') as item from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join found using (doc_id)
""",
    "op12_source_divergence": r"""
with rows as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), words as (select r, lang, source, unnest(w) as term from rows),
kept as (select lang, term from words group by lang, term having count(distinct r) >= 30),
counts as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by all),
groups as (select distinct lang, source from rows),
sizes as (select lang, count(*) as v from kept group by lang),
dense as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), shares as (
  select *, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over (partition by lang, source) + 5 * v) as p from dense join sizes using (lang)
), langs as (
  select lang, term, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over (partition by lang) + 5 * v) as q
  from (select lang, term, sum(c) as c from dense group by all) join sizes using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from shares join langs using (lang, term) where c > 0 and p > q
)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from (from every union all from terms) qualify part = 'pair' or rank <= 50
""",
    "op13_prefix_trie": r"""
with own as (
  select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as x, length(coalesce(text, '')) as points, turn
  from conversations where conv_id is not null
), ranked as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, x) as r, x, points from own
), sizes as (select conv_id, count(*) as len from ranked group by conv_id),
heads as (
  select c.conv_id, c.conv_id - c.conv_id % 100 as base, h, least(h, coalesce(b.len, 0)) as taken, coalesce(b.len, 0) as base_len, c.len
  from (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h from sizes) c left join sizes b on b.conv_id = c.conv_id - c.conv_id % 100
), turns as (
  select c.conv_id, r as d, x, points from heads c join ranked b on b.conv_id = c.base and r <= taken
  union all
  select c.conv_id, r - h + taken, x, points from heads c join ranked using (conv_id) where r > h
), members as (select conv_id, taken + greatest(len - h, 0) as len from heads),
paths as (
  select conv_id, d, points, sha256(string_agg(x, '') over (partition by conv_id order by d rows unbounded preceding)) as p from turns
  union all select conv_id, 0, 0, '' from members
), mapped as (
  select conv_id as member, d, points, p, min(conv_id) over (partition by d, p) as node from paths
), nodes as (
  select node, d, max(points) as points, count(*) as n from mapped group by node, d
), links as (
  select c.node, c.d, m.node as parent from nodes c left join mapped m on m.member = c.node and m.d = c.d - 1
), children as (select parent as node, d - 1 as d, count(*) as n from links where d > 0 group by all),
below as (
  select m.node, m.d, sum((u.n - 1) * u.points) as saved, count(*) filter (k.n is null) as leaves
  from nodes u left join children k on k.node = u.node and k.d = u.d join mapped m on m.member = u.node and m.d <= u.d group by m.node, m.d
), ends as (
  select node, d, sha256(string_agg(cast(member as varchar), ',' order by member)) as digest from mapped join members on conv_id = member and len = d group by node, d
)
select n.node as conv_id, cast(n.d as bigint) as depth, l.parent as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, b.leaves as n_leaves, cast(b.saved as bigint) as saved_tokens,
       coalesce(e.digest, sha256('')) as ends_sha256
from nodes n join links l using (node, d) join below b using (node, d) left join children k using (node, d) left join ends e using (node, d)
""",
}
