"""The operators bound to the test tables, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, katz, linejoin, mixing, quality, rollup, simhash, substring, tokenfiles, warc
from .common import fresh_dir, keep, table, with_facts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: inserts under two versions, a recount of one of them under a
    new version, the same recount sent again (no effect), and deletes of later exact copies."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", F.sha2(text.cast("binary"), 256).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"))
    rows = keep(rows)
    repeated = keep(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = with_facts(rows, repeated, "digest", F.col("doc_id")).where("doc_id != first")

    def change(df: DataFrame, op: str, tokenizer: str, n: str, old: str = "null", old_tokens: str = "null") -> DataFrame:
        return df.selectExpr(f"'{op}' op", "source", "lang", f"'{tokenizer}' tokenizer", f"{n} n_tokens", f"{old} old_tokenizer", f"{old_tokens} old_tokens")

    counts = rollup.Rollup(spark, fresh_dir(spark, "rollup"))
    recount = change(rows, "revise", "bytes-2", "bytes", "'chars-1'", "chars")
    counts.commit("1-inserts", change(rows, "insert", "words-1", "words").union(change(rows, "insert", "chars-1", "chars")))
    counts.commit("2-recount", recount)
    counts.commit("2-recount", recount)
    counts.compact()
    counts.commit("3-deletes", change(copies, "delete", "words-1", "words").union(change(copies, "delete", "bytes-2", "bytes")))
    return counts.totals()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.remove_similar_lines(table(spark, sf_dir, "documents")).drop("removed")


#: Shares of tokens by domain (the label values), and the domain that grows by a tenth.
MIX = {"quality1_toxic0": 0.97, "quality1_toxic1": 0.01, "quality0_toxic0": 0.01, "quality0_toxic1": 0.01}
MIX_OPTIONS = {"anchor": "quality1_toxic0", "scale": 1.1}
#: A corpus has no toxic documents, and of the other domains only the anchor may grow; the weights are for the rest.
CORPUS_OPTIONS = {**MIX_OPTIONS, "unwanted": {"toxic": 1}, "only_anchor_grows": True}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX, **MIX_OPTIONS).drop("p")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fresh_dir(spark, "token-files")
    return tokenfiles.read(spark, out, tokenfiles.write(docs, out, tokenizer_path()))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = fresh_dir(spark, "warc")
    return warc.read(spark, out, warc.write(pages, out))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_substring, op4_token_rollup, op5_line_dedup, op6_mixing, op7_decontaminate, op8_token_files, op9_katz, op10_warc)}
_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_substring": f"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') w from documents),
        win as (select doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 18)) s from w)),
        dup as (select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) n from win) where n > 1),
        gone as (select distinct doc_id, unnest(range(s, s + 20)) k from dup),
        word as (select doc_id, unnest(w) x, generate_subscripts(w, 1) k from w),
        kept as (select doc_id, string_agg(x, ' ' order by k) t from word anti join gone using (doc_id, k) group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(g.n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
        from w left join (select doc_id, count(*) n from gone group by doc_id) g using (doc_id) left join kept using (doc_id)""",
    "op4_token_rollup": f"""
        with d as (select doc_id, source, lang, coalesce(text, '') text, min(doc_id) over (partition by coalesce(text, '')) f from documents),
        v as (select source, lang, 'words-1' tokenizer, len(regexp_extract_all(text, '{_WORDS}')) n from d where doc_id = f
              union all select source, lang, 'bytes-2', strlen(text) from d where doc_id = f)
        select source, lang, tokenizer, count(*)::bigint n_docs, sum(n)::bigint n_tokens from v group by all""",
    # a prefix-filtered join of distinct word sets; 9 |a & b| >= 4 (|a| + |b|) is a Jaccard similarity of 0.8 or more
    "op5_line_dedup": f"""
        with ln as (select doc_id, generate_subscripts(l, 1) k, unnest(l) line from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
        tok as (select doc_id, k, line, list_sort(list_distinct(regexp_extract_all(line, '{_WORDS}'))) w from ln),
        sets as (select row_number() over () sid, w, len(w) n, p from (select w, min((doc_id, k)) p from tok where len(w) > 0 group by w)),
        word as (select sid, unnest(w) x from sets),
        ranked as (select sid, x, row_number() over (partition by sid order by c, x) r from word join (select x, count(*) c from word group by x) using (x)),
        prefix as (select sid, x from ranked join sets using (sid) where r <= n - (4 * n + 4) // 5 + 1),
        pairs as (select distinct a.sid later, b.sid earlier from prefix a join prefix b using (x) where a.sid <> b.sid),
        hit as (select distinct later sid from pairs join sets a on a.sid = later join sets b on b.sid = earlier where b.p < a.p and 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
        judged as (select doc_id, k, line, len(w) > 0 worded, len(w) > 0 and (p <> (doc_id, k) or hit.sid is not null) gone from tok left join sets using (w) left join hit using (sid))
        select doc_id, count(*) filter (worded)::bigint n_lines, count(*) filter (gone)::bigint n_removed, sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) kept_sha256
        from judged group by doc_id""",
    "op7_decontaminate": f"""
        with doc as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        item as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        iw as (select distinct item_id, array_to_string(w[s:s + 9], ' ') x, least(len(w), 10) m from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s from item where len(w) > 0)),
        dw as (select doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') x from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) s from doc, (select distinct m from iw))),
        hit as (select doc_id, s, iw.m, item_id from dw join iw on dw.x = iw.x and dw.m = iw.m),
        words as (select doc_id, count(distinct k) n from (select doc_id, unnest(range(s, s + m)) k from hit) group by doc_id),
        items as (select doc_id, count(*) n, string_agg(i, ',' order by i) names from (select distinct doc_id, item_id::varchar i from hit) group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(words.n, 0)::bigint n_hit, coalesce(items.n, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
        from doc left join words using (doc_id) left join items using (doc_id)""",
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') h from pages),
        f as (select page_id, h, case when strlen(h) >= 100 then min(page_id) over (partition by h) else page_id end f from p)
        select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest, case when f = page_id then 'response' else 'revisit' end record_type,
               case when f = page_id then null else f end refers_to, null::varchar fault from f""",
}
