"""The corpus operators as queries over the driver's tables, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm import backtrack, bpe, embeddings, filter_audit, lexical, media_ts, mixing, pii, sharding, simhash, substring, toxicity, warc
from citewright.session import cut

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")  # the vocabulary and ranks of byte_bpe_50k.tiktoken
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), sharding.balanced_tree(SHARDS))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(media_ts.with_media(_table(spark, sf_dir, "documents")), "media", "zstd")  # a media table in the shared folder
    return media_ts.read_media(stored)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(_table(spark, sf_dir, "documents"))


def op11_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_pii, op3_sharding, op4_bpe, op5_media, op6_substring, op7_toxicity, op8_warc, op9_embeddings, op10_mixing, op11_backtrack, op12_lexical, op13_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring": r"""
            with docs as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
            starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as p from docs where len(w) >= 20),
            windows as (select doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) as k from starts),
            later as (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as n from windows) where n > 1),
            gone as (select distinct doc_id, p + o as i from later, (select unnest(range(0, 20)) as o)),
            cuts as (select doc_id, list(i) as g from gone group by doc_id)
            select d.doc_id, len(w) as n_words, coalesce(len(g), 0) as n_removed,
                   sha256(array_to_string(list_filter(w, lambda x, i: g is null or not list_contains(g, i)), ' ')) as kept_sha256
            from docs d left join cuts c using (doc_id)""",
        "op12_lexical": r"""
            with words as (select 'd' as k, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents
                union all select 'i', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) from benchmark),
            tf as (select id, t, count(*) as tf from words where k = 'd' group by all),
            n as (select id, sum(tf)::bigint as n from tf group by id),
            corpus as (select count(*) as big_n, sum(n)::bigint as l from n),
            m as (select id, 25 + (75 * n * big_n) // l as m, big_n from n, corpus),
            w as (select t, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, corpus group by t),
            s as (select i.id as item_id, d.id as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
                from words i join tf d on i.t = d.t join w on w.t = d.t join m on m.id = d.id where i.k = 'i' group by all having score > 0)
            select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 10""",
        "op13_audit": r"""
            with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, min(doc_id) over (partition by coalesce(text, '')) as f from documents),
            w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
            marks as (select part, quality = 1 as good, toxic = 1 as tox,
                    concat(case when len(ws) < 200 then 'A' end, case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' end,
                        case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' end,
                        case when regexp_matches(t, '[#$%&*|]') then 'D' end, case when doc_id > f then 'E' end) as bad
                from w left join labels using (doc_id)),
            kinds as (select part, bad, count(*) as n, count(*) filter (good) as g, count(*) filter (tox) as x from marks group by all),
            letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
            orders as (select a.l || b.l || c.l || d.l || e.l as o from letters a, letters b, letters c, letters d, letters e
                where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
            ends as (select *, (select min(instr(o, l)) from letters where contains(bad, l)) as gone from kinds, orders),
            s as (select part, o as filter_order, k::int as step, substr(o, k, 1) as l,
                    sum(n) filter (gone is null or gone > k) as kept, sum(n) filter (gone = k) as removed,
                    sum(n) filter (gone < k and contains(bad, substr(o, k, 1))) as redundant, sum(n) filter (bad = substr(o, k, 1)) as uniq,
                    sum(g) filter (gone = k) as good, sum(x) filter (gone = k) as tox
                from ends, (select unnest(range(1, 6)) as k) group by part, o, k)
            select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
                coalesce(uniq, 0)::bigint as unique_fails, coalesce(good, 0)::bigint as good_lost, coalesce(tox, 0)::bigint as toxic_lost,
                coalesce(sum(removed) over (partition by part, l), 0)::bigint as shapley
            from s""",
        "op8_warc": """
            with p as (select page_id, coalesce(html, '') as h from pages),
            q as (select page_id, strlen(h) as n, sha256(h) as d, min(page_id) over (partition by h) as f from p)
            select page_id, n as payload_bytes, d as payload_digest,
                   case when n >= 100 and f <> page_id then 'revisit' else 'response' end as record_type,
                   case when n >= 100 and f <> page_id then f end as refers_to
            from q""",
        "op9_embeddings": """
            with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
                where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
            l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
            r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
            c as (select a, min(b) as component_id from r group by a),
            n as (select a, count(*) as n from l group by a)
            select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
            from embeddings join c on c.a = vec_id left join n on n.a = vec_id""",
    }
