"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, gru_lm, html_text, merkle_manifest, mixing, multi_index, near_dedup, piece_codec, quality_classifier, quality_rules, token_alignment, token_counts, warc
from .common import if_small, scratch, staged


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality_classifier.held_out(F.col("doc_id"))).select("doc_id", "quality")
    scored = quality_classifier.quality_scores(docs, quality_classifier.train(docs, labels))
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_rows(warc.archive_round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


def warc_rows(read: DataFrame) -> DataFrame:
    """Measures of what was read back; a record that fails verification is an error."""
    payload = F.when(F.col("verified"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("unverified record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("binary"))
    measured = read.withColumn("payload", payload).select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha"), "record_type", "refers_to")
    measured = staged(measured, "measured")  # what follows reads a few short columns, and the archives no more
    # a revisit's payload is that of its response
    wanted = measured.where("refers_to is not null").select(F.col("refers_to").alias("target"), F.col("digest").alias("target_digest")).distinct()
    targets = measured.where("record_type = 'response'").select(F.col("page_id").alias("target"), F.col("digest").alias("target_digest"), F.col("bytes").alias("target_bytes"), F.col("sha").alias("target_sha"))
    targets = staged(targets.join(wanted, ["target", "target_digest"], "left_semi").dropDuplicates(["target", "target_digest"]), "targets")
    out = lambda frame, n, sha: frame.select("page_id", F.col(n).alias("payload_bytes"), F.col(sha).alias("payload_digest"), "record_type", "refers_to")
    revisits = measured.where("refers_to is not null").join(if_small(targets), (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("target_digest")), "left")
    return out(measured.where("refers_to is null"), "bytes", "sha").unionByName(out(revisits, "target_bytes", "target_sha"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.bpe_encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_texts(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.taken(mixing.mix_plan(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle_manifest.manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.piece_encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    aligned = staged(aligned.withColumns({"n_groups": F.col("n_links"), "groups_sha256": token_alignment.digest(F.col("groups"))}).drop("groups"), "aligned")  # a group has one link
    found = token_alignment.linked(aligned, keep=("n_groups", "groups_sha256"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_multi_index, op4_html_text, op5_token_counts, op6_bpe_codec, op7_minhash_dedup, op8_quality_rules, op9_gru_lm, op10_mixing, op11_merkle_manifest, op12_piece_codec, op13_token_alignment)
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b, sha256(coalesce(html, '')) as d from pages),
        f as (select d, min(page_id) as first from p where octet_length(b) >= 100 group by d)
        select page_id, octet_length(b)::bigint as payload_bytes, p.d as payload_digest,
               case when first < page_id then 'revisit' else 'response' end as record_type,
               case when first < page_id then first end as refers_to
        from p left join f on p.d = f.d
    """,
    "op11_merkle_manifest": """
        with recursive d as (select doc_id, source, lang, n_chars, text, list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
                lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::ubigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint))) as c from documents),
        f as (select *, concat(coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-'), coalesce(strlen(source)::varchar || ':' || source::varchar, '-'), coalesce(strlen(lang)::varchar || ':' || lang::varchar, '-'), coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-')) as given,
                case when doc_id is not null and xor(c, 4294967295::ubigint) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as touched from d),
        l as (select doc_id, source, sha256(concat(given, coalesce(strlen(text)::varchar || ':' || text::varchar, '-'))) as leaf, sha256(concat(given, coalesce(strlen(touched)::varchar || ':' || touched::varchar, '-'))) as start from f),
        s as (select source, count(*) as n, row_number() over (order by source nulls first) - 1 as tree from l group by source),
        k as (select doc_id, leaf, start, tree, n, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from l join s on l.source is not distinct from s.source),
        nodes as (select tree, 0 as level, pos, n, leaf as digest from k
            union all select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 16, n),
        up as (select 0 as level, tree as pos, (select count(*) from s) as n, digest from nodes where n = 1
            union all select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from up where n > 1 group by level, pos // 16, n),
        runs as (select tree, level, pos // 16 as run, list(digest order by pos) as ds from nodes where n > 1 group by tree, level, pos // 16),
        above as (select level, pos // 16 as run, list(digest order by pos) as ds from up where n > 1 group by level, pos // 16),
        climb as (select tree, pos as leaf_pos, 0 as level, pos, start as f, '' as proof from k
            union all select c.tree, leaf_pos, c.level + 1, c.pos // 16, sha256(concat(array_to_string(ds[1:c.pos % 16], ''), f, array_to_string(ds[c.pos % 16 + 2:], ''))),
                concat(proof, array_to_string(ds[1:c.pos % 16], ''), array_to_string(ds[c.pos % 16 + 2:], '')) from climb c join runs r on r.tree = c.tree and r.level = c.level and r.run = c.pos // 16),
        tops as (select tree, leaf_pos, arg_max(f, level) as f, arg_max(proof, level) as proof from climb group by tree, leaf_pos),
        rise as (select tree, leaf_pos, 0 as level, tree as pos, f, proof from tops
            union all select c.tree, leaf_pos, c.level + 1, c.pos // 16, sha256(concat(array_to_string(ds[1:c.pos % 16], ''), f, array_to_string(ds[c.pos % 16 + 2:], ''))),
                concat(proof, array_to_string(ds[1:c.pos % 16], ''), array_to_string(ds[c.pos % 16 + 2:], '')) from rise c join above r on r.level = c.level and r.run = c.pos // 16),
        ends as (select tree, leaf_pos, arg_max(f, level) as folded_root, sha256(arg_max(proof, level)) as proof_sha256 from rise group by tree, leaf_pos),
        root as (select digest as root from up where n = 1)
        select doc_id, leaf, b.digest as subroot, root, proof_sha256, folded_root, folded_root = root as verified
        from k join ends on k.tree = ends.tree and k.pos = ends.leaf_pos join nodes b on b.tree = k.tree and b.n = 1, root
    """,
}
