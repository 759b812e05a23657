"""One query per operator, over the whole of its table: ``(spark, folder) -> DataFrame``.

The operators keep their own interfaces; the queries derive the columns asked for.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.llm.ball_topk import quantised, top_products
from tollgate.llm.common import table
from tollgate.llm.license_scan import GAP, LINE_END, OPERATOR, RULES, SENTENCE_END, WORD, scan_licences, variants
from tollgate.llm.norm_search import ranked_documents
from tollgate.llm.orc_tokens import read_tokens, token_checksums, write_tokens
from tollgate.llm.pivotal_mix import copies_by_row, mix_sources
from tollgate.llm.prefix_bpe import encode_documents
from tollgate.llm.private_spans import find_spans
from tollgate.llm.signature_join import near_duplicates
from tollgate.llm.target_resample import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample
from tollgate.llm.tiled_cosine import cosine_links, finite
from tollgate.llm.toxicity import scored_documents
from tollgate.llm.tree_extract import extract_pages
from tollgate.llm.viterbi_count import count_tokens
from tollgate.session import scratch_path

WORD_VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
END_ID = 1


def op1_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    write_tokens(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY), END_ID, path)
    return token_checksums(read_tokens(spark, path))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))


def op3_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_tiled_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return cosine_links(table(spark, folder, "embeddings"))


def op5_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = copies_by_row(mix_sources(table(spark, folder, "documents")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op6_viterbi_count(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op7_tree_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


def op8_ball_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(finite("embedding"))
    vectors = rows.select(F.col("vec_id").cast("long"), quantised("embedding").alias("vector"))
    return top_products(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(
        table(spark, folder, "documents"),
        public_tokenizers.path(BYTE_RANKS),
        public_tokenizers.PATTERN,
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_private_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = find_spans(table(spark, folder, "documents"))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op12_norm_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_target_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_orc_tokens": op1_orc_tokens,
    "op2_license_scan": op2_license_scan,
    "op3_signature_join": op3_signature_join,
    "op4_tiled_cosine": op4_tiled_cosine,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_viterbi_count": op6_viterbi_count,
    "op7_tree_extract": op7_tree_extract,
    "op8_ball_topk": op8_ball_topk,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_private_spans": op11_private_spans,
    "op12_norm_search": op12_norm_search,
    "op13_target_resample": op13_target_resample,
}


def _licence_sql() -> str:
    """The scan by joins and one step per rule; sentences and rules are given as values."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    known = ", ".join(
        f"({quoted(name)}, trim(regexp_replace(lower({quoted(s)}), '[^a-z0-9]+', ' ', 'g')))" for name, s in variants()
    )
    steps = []
    for kind, end in (("sentence", SENTENCE_END), ("line", LINE_END)):
        steps.append(f"""{kind}_cut as (select doc_id, string_split_regex(coalesce(text, ''), {quoted(end)}) x from documents),
            {kind}_parts as (select doc_id, unnest(x) s, unnest(range(1, len(x) + 1)) pos from {kind}_cut),
            {kind}_places as (
                select doc_id, pos, unnest(string_split_regex(s, {quoted(OPERATOR)})) part,
                       unnest(range(len(string_split_regex(s, {quoted(OPERATOR)})))) n
                from {kind}_parts where regexp_matches(s, {quoted(WORD)})),
            {kind}_known as (
                select doc_id, pos, count(*) parts, count(id) found, count(*) filter (id like 'spdx-%') tags,
                       string_agg(id, '||spdx||' order by n) ids
                from {kind}_places left join known
                  on trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^a-z0-9]+', ' ', 'g')) = sentence
                group by doc_id, pos),
            {kind}_ids as (
                select doc_id, pos, case when found = 1 and parts = 1 or tags = parts then ids else '{GAP}' end id
                from {kind}_known),
            {kind}_0 as (
                select doc_id, string_agg('|' || id || '|', '' order by pos) seq, count(*) filter (id <> '{GAP}') n,
                       cast([] as varchar[]) names
                from {kind}_ids group by doc_id having n > 0)""")
        for i, (name, ids) in enumerate(RULES):
            rule = quoted("".join(f"|{x}|" for x in ids))
            steps.append(f"""{kind}_{i + 1} as (
                select doc_id, replace(seq, {rule}, '|{GAP}|') seq, n,
                       case when contains(seq, {rule}) then list_append(names, {quoted(name)}) else names end names
                from {kind}_{i})""")
    last = len(RULES)
    return f"""
        with known(id, sentence) as (values {known}), {", ".join(steps)}
        select d.doc_id, coalesce(a.n, 0) n_known,
               array_to_string(list_sort(list_distinct(list_concat(
                   coalesce(a.names, cast([] as varchar[])), coalesce(b.names, cast([] as varchar[]))))), ',') licences
        from documents d left join sentence_{last} a on a.doc_id = d.doc_id left join line_{last} b on b.doc_id = d.doc_id
    """


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _resample_sql() -> str:
    """Every step as the definition says; the CRC-32 byte by byte from its table of 256."""
    crc = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        crc.append(c)
    return rf"""
        with w as (
            select 0 t, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
            union all
            select 1, null, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
        ), d as (
            select distinct unnest(ws) word from w
        ), h as (
            select word, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(
                range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::bigint)),
                lambda c, b: xor(c >> 8, ({crc}::bigint[])[(xor(c, b) & 255) + 1]))) % {BUCKETS} bucket
            from d
        ), f as (
            select t, doc_id, unnest(ws) word from w
        ), c as (
            select bucket, sum(1 - t) s, sum(t) t from f join h using (word) group by bucket
        ), a as (
            select sum(s) s, sum(t) t from c
        ), g as (
            select bucket, floor(1000 * ln((c.t + 1)::double * (a.s + {BUCKETS})::double
                                           / ((c.s + 1)::double * (a.t + {BUCKETS})::double)))::bigint gain
            from c, a
        ), x as (
            select doc_id, sum(gain) gain from f join h using (word) join g using (bucket) where f.t = 0 group by doc_id
        ), y as (
            select doc_id, len(ws) n_features, case when len(ws) = 0 then 0 else floor(gain / len(ws))::bigint end weight,
                   ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint u
            from w left join x using (doc_id) where w.t = 0
        ), z as (
            select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((u + 0.5) / 4294967296)))::bigint score from y
        ), r as (
            select *, n_features >= {LEAST_WORDS} enough, row_number() over (
                partition by n_features >= {LEAST_WORDS} order by score desc, doc_id) place from z
        )
        select doc_id, n_features, weight, score, case when enough and place <=
               (select {PERCENT} * count(*) // 100 from r where enough) then place end rank from r
    """


# SQL for DuckDB where it can express a query; the others have brute-force tests.
SQL: dict[str, str] = {
    "op2_license_scan": _licence_sql(),
    "op3_signature_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') ws
            from documents
        ), g as (
            select doc_id, case when len(ws) >= 5
                then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end sh
            from w
        ), n as (
            select doc_id, len(sh) n from g
        ), s as (
            select doc_id, unnest(sh) sh from g
        ), o as (
            select a.doc_id x, b.doc_id y, count(*) o from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id
        ), l as (
            select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 75 * (a.n + b.n - o)
        ), r as (
            select doc_id, doc_id reach from n
            union
            select r.doc_id, l.y from r join l on r.reach = l.x
        )
        select n.doc_id, n.n n_shingles, min(reach) component_id from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n
    """,
    "op4_tiled_cosine": """
        with recursive v as (
            select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
        ), u as (
            select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) norm from v where label is not null
        ), l as (
            select a.vec_id x, b.vec_id y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
            where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ), r as (
            select vec_id, vec_id reach from v
            union
            select r.vec_id, l.y from r join l on r.reach = l.x
        ), c as (
            select vec_id, min(reach) component_id from r group by vec_id
        ), d as (
            select x, count(*) n from l group by x
        )
        select c.vec_id, coalesce(n, 0) n_links, component_id, c.vec_id = component_id kept
        from c left join d on d.x = c.vec_id
    """,
    "op12_norm_search": rf"""
        with d as (
            select doc_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents
        ), q as (
            select item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark
        ), n as (
            select doc_id, count(*) n from d group by doc_id
        ), c as (
            select count(*) docs, cast(sum(n) as bigint) terms from n
        ), m as (
            select doc_id, 75 + (25 * n * docs) // terms m from n, c
        ), t as (
            select doc_id, term, count(*) tf from d group by doc_id, term
        ), w as (
            select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) w
            from t, c group by term, docs
        ), s as (
            select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) score
            from q join t using (term) join w using (term) join m using (doc_id) group by item_id, doc_id
        ), r as (
            select *, row_number() over (partition by item_id order by score desc, doc_id) n from s where score > 0
        )
        select item_id, cast(n as integer) rank, doc_id, score from r where n <= 20
    """,
    "op13_target_resample": _resample_sql(),
    "op8_ball_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q
            from embeddings
        ), s as (
            select a.vec_id query_id, b.vec_id,
                   cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) score
            from v a join v b on a.vec_id <> b.vec_id
            where a.vec_id % 50 = 0
        ), r as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) n from s
        )
        select query_id, cast(n as integer) rank, vec_id, score from r where n <= 5
    """,
}
