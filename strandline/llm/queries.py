"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_classifier, warc
from .chat_format import format_conversations, read_loss, read_turns
from .conversation_repair import repair_conversations
from .decontaminate import contained_items
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_components
from .quality_rules import learn_rules, with_statistics, with_verdict
from .spelling import variants_of_documents
from .substring_dedup import without_repeated_windows
from .url_filters import filter_urls
from ._scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark, "rules").keep(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    judged = with_verdict(stats, learn_rules(stats, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality_classifier.held_out(5, 0)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.with_scores(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before and after, and the length and digest of the remaining text."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("line_count_in").alias("n_lines"), F.col("line_count_out").alias("n_kept"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality_classifier.held_out(3, 1)
    return language_id.with_languages(docs, language_id.train(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: The list that op6 applies: verdict, host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("blocked"))
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, labels)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it contains."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and epoch in which the mixture emits it."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_place", "mix_key", "mix_weight")


#: A conversation that says control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = format_conversations(turns.unionByName(probe))
    out = out.withColumns({"turns": read_turns(F.col("formatted")), "loss": F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "")})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which one page in 53 lost its last character and one in 97 is gone."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    harm = F.crc32(F.col("page_id").cast("string").cast("binary"))
    records = warc.as_records(pages)
    left = pages.where((harm % 97 != 0) | (harm % 53 == 0))
    damaged = left.withColumn("html", F.when(harm % 53 == 0, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html")))
    scratch = Scratch(spark, "fixity")
    records = scratch.keep(records, "manifest")
    return warc.fixity_report(records, warc.as_replica(damaged, records, scratch), scratch).select("page_id", "file", "seq", "offset", "length", "digest", "status")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words cut out, and the digest of those that stay."""
    left = without_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), width=20)
    kept = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a checksum of ``conv_id:turn``: dropped, emptied, without ends of sentences, repeated, or said by the user."""
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", fault.alias("fault"), *(F.coalesce(c, F.lit(" ")).alias(f"was_{c}") for c in ("role", "text"))).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("was_text", "[.!?]", "")).otherwise(F.col("was_text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("was_role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "was_role", "was_text", F.explode(copies).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns, for all conversations, damaged first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged_turns(turns), order=("turn", "was_role", "was_text", "copy"))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    found = found.withColumn("repaired", said)
    whole = turns.select("conv_id").distinct().alias("c").join(found.alias("f"), F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("c.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters or more that occur three times or more, each with its commoner spelling one edit away."""
    return variants_of_documents(table(spark, sf_dir, "documents"), least_chars=5, least_n=3, drop_every=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_url_filters": op6_url_filters,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_temperature_mixing": op8_temperature_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_warc_fixity": op10_warc_fixity,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = """w AS (SELECT {key}, list_filter(string_split_regex(coalesce({text}, ''), '{gap}'), lambda x: x <> '') AS w FROM {table}),
    g AS (SELECT {key}, unnest(CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) WHEN len(w) > 0 THEN ['=' || array_to_string(w, ' ')] ELSE [] END) AS s FROM w)"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE {_SHINGLES.format(key="doc_id", text=_ASCII, gap="[\\x20\\x09-\\x0D]+", table="documents", n=4)},
        k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
        SELECT doc_id, coalesce(any_value(k.n), 0) AS n_shingles, least(doc_id, coalesce(min(other), doc_id)) AS component_id FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY doc_id""",
    "op7_benchmark_decontamination": f"""WITH {_SHINGLES.format(key="doc_id", text="lower(text)", gap="[^\\p{L}\\p{N}]+", table="documents", n=5).replace("w AS", "dw AS").replace("FROM w)", "FROM dw)").replace("g AS", "dg AS")},
        {_SHINGLES.format(key="item_id", text="lower(text)", gap="[^\\p{L}\\p{N}]+", table="benchmark", n=5)},
        q AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT doc_id, item_id, count(*) AS n FROM dg JOIN g USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, q.n AS n_item, c.n AS n_common, c.n / q.n AS containment FROM c JOIN q USING (item_id) WHERE 100 * c.n >= 80 * q.n""",
    "op9_chat_formatting": f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(24 + length(role) + length(replace(text, '<|', '<||')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id""",
    "op11_substring_dedup": """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END)) AS s FROM w),
        r AS (SELECT doc_id, p, word, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM g),
        c AS (SELECT doc_id, p, word, coalesce(p - max(p) FILTER (again) OVER (PARTITION BY doc_id ORDER BY p) < 20, false) AS gone FROM r)
        SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""",
}
