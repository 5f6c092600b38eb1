"""All registered queries of the core library; their SQL counterparts stand in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintero.functions.text import parse_date, word_count
from tintero.operators import aggregate, clean, enrich, layout, links, normalize, quality, scanned_clean, score, segment
from tintero.plans.oracles import ORACLES
from tintero.runtime import shared_folder, table
from tintero.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["ORACLES", "QUERIES"]


def _on(name: str, *tables: str):
    """Register a function of the named tables."""

    def add(fn):
        QUERIES[name] = lambda spark, d: fn(*(table(spark, d, t) for t in tables))
        return fn

    return add


PAGES, PARAS, SCORED, META, LIST = "scanned_pdfs_extracted_text", "unified_paragraphs_segmented", "scored_paragraphs", "cf_metadata", "list_rows"
r6 = lambda c: F.round(c, 6)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


# Document scores and corpus aggregates


@_on("a1_document_scores", SCORED)
def _(s):
    return _rounded(aggregate.document_scores(s), "avg_risk_score", "avg_risk_index", "tone_index")


@_on("a2_tone_index", SCORED)
def _(s):
    return s.groupBy(F.col("fiscal_risk_score").alias("score")).agg(F.count("*").alias("n")).withColumn("tone", score.tone_index(F.col("score")))


@_on("a6_score_counts", SCORED)
def _(s):
    return _rounded(aggregate.value_counts(s, "fiscal_risk_score"), "pct")


@_on("a7_corpus_tone", SCORED)
def _(s):
    return _rounded(aggregate.corpus_tone(aggregate.document_scores(s)), "mean_score", "std_score", "mean_tone", "std_tone")


@_on("a8_reduction_summary", PAGES)
def _(p):
    return _rounded(aggregate_reduction(p), "reduction_pct", "mean_reduction_pct")


def aggregate_reduction(p):
    return clean.reduction_summary(clean.clean_pages(p))


@_on("a10_upper_median", PARAS)
def _(p):
    return _rounded(aggregate.upper_median(p, F.length("text")), "mean_value")


@_on("a12_length_profile", PARAS)
def _(p):
    return _rounded(aggregate.length_profile(p), "mean", "std_pop", "target_share")


for _col in ("doc_type", "source_type", "year"):
    QUERIES[f"a13_by_{_col}"] = lambda spark, d, c=_col: aggregate.grouped_counts(table(spark, d, SCORED), c)


@_on("a15_rejection_reasons", PARAS)
def _(p):
    return _rounded(quality.reasons(p), "pct")


@_on("a16_source_mix", PARAS)
def _(p):
    return _rounded(aggregate.value_counts(p, "source_type"), "pct")


@_on("a17_removals_by_reason", PAGES)
def _(p):
    return scanned_clean.removals_by_reason(scanned_clean.removals(p))


@_on("a18_removals_by_file", PAGES)
def _(p):
    return scanned_clean.removals_by_file(scanned_clean.removals(p))


@_on("a19_longest_removal", PAGES)
def _(p):
    return scanned_clean.longest_removal(scanned_clean.removals(p))


@_on("a21_corpus_statistics", PARAS)
def _(p):
    return _rounded(aggregate.corpus_statistics(p), "mean_length", "std_samp", "std_pop", "p5", "p10", "p25", "p50", "p75", "p90", "p95", "p99")


@_on("a22_typed_documents", SCORED)
def _(s):
    return s.where("doc_type IS NOT NULL").groupBy("doc_type").agg(F.count("*").alias("paragraphs"), F.countDistinct("pdf_filename").alias("documents"))


@_on("a23_histogram", PARAS)
def _(p):
    return aggregate.histogram(p, F.length("text"))


@_on("a24_per_document", PARAS)
def _(p):
    return aggregate.per_document(p)


@_on("a25_stage_counts", META)
def _(m):
    return m.groupBy("pdf_type").agg(F.count("*").alias("n"))


@_on("a26_page_totals", PAGES)
def _(p):
    return aggregate.page_totals(p)


@_on("a27_rule_counts", PAGES)
def _(p):
    return clean.rule_counts(p)


@_on("a29_removal_flags", PAGES)
def _(p):
    a = scanned_clean.removals(p)
    return a.groupBy(F.when(F.col("reason") == "capitals", "capitals").when(F.col("reason") == "too_short", "short").otherwise("pattern").alias("category")).agg(F.count("*").alias("n"), r6(F.avg("caps_ratio")).alias("caps_ratio"))


# Cleaning


@_on("c_clean_pages", PAGES)
def _(p):
    return clean.clean_pages(p).select("page_id", "cleaned_text", "original_length", "cleaned_length", r6(F.col("reduction_pct")).alias("reduction_pct"))


@_on("c_clean_documents", "documents")
def _(d):
    x = d.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return clean.clean_pages(x, aggressive=True).select("doc_id", "cleaned_text")


@_on("c4_headers", PAGES)
def _(p):
    return p.where("text IS NOT NULL").select("page_id", F.size(F.filter(F.split("text", "\n\n"), lambda s: clean.is_header(F.trim(s)))).alias("n_headers"), F.size(F.filter(F.split("text", "\n\n"), lambda s: clean.is_label(F.trim(s)))).alias("n_labels"))


@_on("n0_preliminary", PAGES)
def _(p):
    return scanned_clean.stage(p, scanned_clean.preliminary).select("page_id", "text")


@_on("n1_from_opinion", PAGES)
def _(p):
    return scanned_clean.from_opinion(p).select("page_id", "text")


@_on("n2_without_annexes", PAGES)
def _(p):
    return scanned_clean.without_annexes(p).select("page_id", "text")


@_on("n3_without_letters", PAGES)
def _(p):
    return scanned_clean.without_letters(p).select("page_id")


@_on("n4_false_breaks", PAGES)
def _(p):
    return scanned_clean.stage(p, scanned_clean.join_false_breaks).select("page_id", "text")


@_on("n5_headings", PAGES)
def _(p):
    return scanned_clean.stage(p, scanned_clean.drop_headings).select("page_id", "text")


@_on("n6_noise", PAGES)
def _(p):
    return scanned_clean.stage(p, scanned_clean.drop_noise).select("page_id", "text")


@_on("n7_final", PAGES)
def _(p):
    return scanned_clean.stage(p, scanned_clean.final_touch).select("page_id", "text")


@_on("n_scanned_pages", PAGES)
def _(p):
    return scanned_clean.clean_scanned(p).select("page_id", "pdf_filename", "page", "text")


# Segmentation


@_on("u1_tagged_union", PAGES)
def _(p):
    by = enrich_kind(p)
    return segment.tagged_union(p.where(by).select("pdf_filename", "page"), p.where(~by).select("pdf_filename", "page")).groupBy("source_type").agg(F.count("*").alias("n"))


def enrich_kind(p):
    return F.lower("pdf_filename").startswith("informe")


@_on("w1_page_pairs", PAGES)
def _(p):
    return segment.pair_pages(p).select("pdf_filename", "page_range", "text", "n_pages")


@_on("w1i_open_pages", PAGES)
def _(p):
    return segment.pair_pages(p, mode="intended").groupBy("pdf_filename").agg(F.count("*").alias("n_units"), F.max("n_pages").alias("longest"))


@_on("x8_paragraphs", PAGES)
def _(p):
    return segment.paragraphs_of(p).select("page_id", "position", "text", "length")


@_on("w6_numbered_paragraphs", PARAS)
def _(p):
    return segment.number_rows(p.where("length(text) >= 20").select("pdf_filename", "row_id"), ["pdf_filename", "row_id"])


@_on("w7_words_per_paragraph", PARAS)
def _(p):
    return p.select("row_id", F.when(F.col("text").isNotNull(), word_count(F.col("text"))).alias("words"))


@_on("w10_word_chunks", PARAS)
def _(p):
    x = p.where("text IS NOT NULL").select("row_id", segment.split_by_words(F.col("text"), 100).alias("c"))
    return x.select("row_id", F.posexplode("c").alias("chunk", "text")).select("row_id", "chunk", "text")


@_on("w11_first_documents", PARAS)
def _(p):
    return aggregate.first_documents(p)


@_on("u4_distinct_texts", "documents")
def _(d):
    return segment.drop_duplicates(d.where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"]).select("doc_id")


# Quality


@_on("f12_graded", PARAS)
def _(p):
    return quality.graded(p.select("row_id", "text")).select("row_id", "reason")


@_on("f12_valid", PARAS)
def _(p):
    return quality.valid(p).select("row_id")


# Metadata and increments


@_on("x1_enriched", LIST)
def _(x):
    return enrich.enrich(x).select("date", "year", "month", "page_url", "doc_title", "doc_type", "doc_number")


@_on("x4_dates", LIST)
def _(x):
    return x.groupBy(parse_date(F.col("date")).alias("day")).agg(F.count("*").alias("n"))


@_on("j1_with_metadata", PARAS, META)
def _(p, m):
    return enrich.with_metadata(p.select("row_id", "pdf_filename"), m).select("row_id", "pdf_filename", "date", "year", "month", "pdf_type", "doc_title", "doc_type", "doc_number")


@_on("j1_latest_metadata", META)
def _(m):
    return enrich.latest(m).select("pdf_filename", "doc_title", "scraped_at")


@_on("j3_new_rows", LIST, META)
def _(x, m):
    return enrich.only_new(x, m, "page_url").select("page_url", "doc_title")


@_on("j5_missing_files", META, PAGES, PARAS)
def _(m, p, q):
    return enrich.missing_files(m, p, q).select("pdf_filename").distinct()


@_on("j6_typed", META, PAGES, PARAS)
def _(m, p, q):
    return enrich.update_type(m, q.where("source_type = 'editable'"), p).groupBy("pdf_type").agg(F.count("*").alias("n"))


@_on("k7_without_denied", META)
def _(m):
    return enrich.without_denied(m, m.where("pdf_type IS NULL")).select("pdf_filename", "scraped_at")


@_on("u2_appended", META, LIST)
def _(m, x):
    return enrich.append_new(m.select("page_url", "doc_title", "pdf_url"), x.select("page_url", "doc_title"), "page_url").groupBy(F.col("pdf_url").isNull().alias("without_url")).agg(F.count("*").alias("n"))


@_on("t2_by_date", META)
def _(m):
    return enrich.sort_by_date(m).select("date", "pdf_filename")


@_on("t5_first_unmatched", PARAS, META)
def _(p, m):
    return p.join(m.select("pdf_filename").distinct(), "pdf_filename", "left_anti").select("pdf_filename").distinct().orderBy("pdf_filename").limit(10)


@_on("f4_with_url", META)
def _(m):
    return m.dropna(subset=["pdf_url"]).select("pdf_filename", "scraped_at", links.file_of(F.col("pdf_url")).alias("file"))


# Links


@_on("f1_presentations", LIST)
def _(x):
    return x.select("doc_title", links.is_presentation(F.col("doc_title")).alias("presentation")).groupBy("presentation").agg(F.count("*").alias("n"))


@_on("t1_best_links", META)
def _(m):
    w = Window.partitionBy("page_url").orderBy("scraped_at", "pdf_filename")
    x = m.where("pdf_url IS NOT NULL AND page_url IS NOT NULL").select("page_url", F.col("pdf_url").alias("href"), F.col("doc_title").alias("label"), F.row_number().over(w).alias("pos"))
    return links.best_link(x).select("page_url", "href")


@_on("x5_link_scores", META)
def _(m):
    return m.groupBy(links.link_score(F.coalesce("pdf_url", F.lit(""))).alias("score")).agg(F.count("*").alias("n"))


# Layout: events stand for words (users for pages, seconds for heights)


@_on("w5_event_sessions", "events")
def _(e):
    s = layout.gap_sessions(e, ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@_on("w5_absolute_gaps", "events")
def _(e):
    s = layout.gap_sessions(e, ["user_id"], ["event_id"], F.col("value"), 20.0, absolute=True)
    return s.groupBy("user_id").agg(F.max("session").alias("last_session"))


@_on("f15_before_annex", PAGES)
def _(p):
    return layout.before_annex(p).select("page_id", "text")


@_on("s7_type_by_text", PAGES)
def _(p):
    return layout.extracted(p.select("pdf_filename", "page", "text")).groupBy("pdf_type").agg(F.count("*").alias("n"))


@_on("x16_lateral_cuts", "part")
def _(p):
    return p.select("p_partkey", layout.lateral_cuts((F.col("p_partkey") % 900).cast("int")).alias("c")).select("p_partkey", "c.x1", "c.x2")


# Length normalisation


@_on("x11_neighbour_cosine", "embeddings")
def _(e):
    return normalize.neighbour_similarity(e, "label", "vec_id", "embedding").select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@_on("w8_chunks", "embeddings")
def _(e):
    s = normalize.neighbour_similarity(e, "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))
    return normalize.split_points(s, "label", "vec_id").groupBy("label").agg(F.max("chunk").alias("last_chunk"), F.count("*").alias("n"))


@_on("w8_packed", PARAS)
def _(p):
    x = p.where("length(text) > 1000").select("row_id", normalize.pack_chunks(F.split("text", r"(?<=[.!?])\s+"), keep_all=True).alias("c"))
    return x.select("row_id", F.posexplode("c").alias("chunk", "text"))


@_on("w9_merged", PARAS)
def _(p):
    x = p.where("text IS NOT NULL").select("pdf_filename", "row_id", F.length("text").alias("len"), F.lit(1.0).alias("similarity"))
    return normalize.merge_short(x, "pdf_filename", "row_id", "len").select("row_id", "merge_id", "merged")


# Scoring


@_on("v5_scored", SCORED)
def _(s):
    return score.score_rows(score.pending(s).select("paragraph_num", "text", "fiscal_risk_score")).select("paragraph_num", "fiscal_risk_score", "risk_index")


@_on("f21_pending", SCORED)
def _(s):
    return score.pending(s).groupBy("pdf_filename").agg(F.count("*").alias("n"))


@_on("x12_prompts", PARAS)
def _(p):
    return p.select("row_id", F.length(score.prompt(F.col("text"), "Contexto. ", 'Clasifica: """{text}""" Responde:')).alias("prompt_chars"))


@_on("x13_replies", "events")
def _(e):
    return e.select("event_id", score.parse_reply(F.concat(F.lit(" "), F.get_json_object("props", "$.k"))).alias("score"))


@_on("t8_batches", SCORED)
def _(s):
    n = segment.number_rows(s.select("pdf_filename", "paragraph_num", "text").withColumn("t", F.md5(F.coalesce("text", F.lit("")))).drop("text"), ["pdf_filename", "paragraph_num", "t"], "n")
    return n.groupBy(F.floor((F.col("n") - 1) / 100).alias("batch")).agg(F.count("*").alias("n_rows"), F.min("paragraph_num").alias("first_num"))


# Sorts, defaults, formats


@_on("f19_defaults", PAGES)
def _(p):
    return p.select("page_id", F.coalesce("pdf_filename", F.lit("")).alias("pdf_filename"), F.coalesce("page", F.lit(0)).alias("page"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


@_on("f22_significant", PAGES)
def _(p):
    return clean.clean_pages(p).where("reduction_pct > 5").select("page_id")


@_on("j7_unsegmented_pages", PAGES, PARAS)
def _(p, q):
    return enrich.only_new(p, q, "pdf_filename").groupBy("pdf_filename").agg(F.count("*").alias("pages"))


@_on("j8_rejects_of_main_reasons", PARAS)
def _(p):
    main = quality.reasons(p).orderBy(F.desc("n"), "reason").limit(3).select(F.col("reason").alias("_r"))
    r = quality.rejected(p.select("row_id", "text")).withColumn("_r", F.regexp_replace("reason", r" \(\d+ chars\)$", ""))
    return r.join(F.broadcast(main), "_r", "left_semi").select("row_id")  # three reasons


@_on("t3_page_order", PAGES, PARAS)
def _(p, q):
    u = segment.tagged_union(p.select("pdf_filename", "page"), q.select("pdf_filename", F.split("page_range", "-")[0].try_cast("int").alias("page")))
    return u.groupBy("pdf_filename", "source_type").agg(F.min("page").alias("first_page"), F.count("*").alias("n")).orderBy("pdf_filename", F.when(F.col("source_type") == "scanned", 0).otherwise(1))


@_on("t4_most_removals", PAGES)
def _(p):
    return scanned_clean.removals_by_file(scanned_clean.removals(p)).orderBy(F.desc("n"), "pdf_filename").limit(10)


@_on("t7_year_series", SCORED)
def _(s):
    return s.where("year IS NOT NULL AND year != ''").groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("paragraphs"), r6(F.avg("risk_index")).alias("tone")).orderBy("year")


@_on("x19_formatted", PARAS)
def _(p):
    return p.groupBy("source_type").agg(F.format_number(F.sum(F.length(F.coalesce("text", F.lit("")))), 0).alias("chars"))


# Results row by row, and operators on columns that the tables offer


@_on("s7_types_by_file", PAGES)
def _(p):
    short = p.select("pdf_filename", "page", F.substring("text", 1, 4).alias("text"))  # page tops: files of both kinds
    return layout.extracted(short)


@_on("f1_by_document", "documents")
def _(d):
    return d.select("doc_id", links.is_presentation(F.col("text")).alias("presentation"))


@_on("j5_missing_rows", META, SCORED, PAGES)
def _(m, s, p):
    known = s.where("paragraph_num % 2 = 0").select("pdf_filename")  # a listing in which files are missing
    return enrich.missing_files(m, known, p.where("page > 3").select("pdf_filename")).select("pdf_filename", "scraped_at")


@_on("j6_typed_rows", META, PAGES, PARAS)
def _(m, p, q):
    return enrich.update_type(m, q.where("source_type = 'editable'"), p.where("page = 2")).select("pdf_filename", "scraped_at", "pdf_type")


@_on("j7_unsegmented_rows", PAGES, PARAS)
def _(p, q):
    return enrich.only_new(p, q.where("source_type = 'scanned'"), "pdf_filename").select("page_id")


@_on("u1_tagged_rows", PAGES)
def _(p):
    by = enrich_kind(p)
    return segment.tagged_union(p.where(by).select("page_id", "page"), p.where(~by).select("page_id", "pdf_filename"))


@_on("u2_appended_rows", META, LIST)
def _(m, x):
    return enrich.append_new(m.select("page_url", "doc_title", "pdf_url"), x.select("page_url", "doc_title"), "page_url")


@_on("w1i_open_texts", PAGES)
def _(p):
    return segment.pair_pages(p, mode="intended").select("pdf_filename", "page_range", "text", "n_pages")


@_on("w8_chunk_rows", "embeddings")
def _(e):
    s = normalize.neighbour_similarity(e, "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))
    return normalize.split_points(s, "label", "vec_id").select("vec_id", "label", "chunk")


@_on("w9_merged_by_similarity", PARAS, "embeddings")
def _(p, e):
    # Vectors stand for paragraphs: the one whose number is the paragraph's.
    x = p.where("text IS NOT NULL").join(e.select(F.col("vec_id").alias("row_id"), "embedding"), "row_id").select("pdf_filename", "row_id", F.length("text").alias("len"), "embedding")
    x = normalize.neighbour_similarity(x, "pdf_filename", "row_id", "embedding").withColumn("similarity", F.round("similarity", 6)).drop("embedding")
    return normalize.merge_short(x, "pdf_filename", "row_id", "len", short=400, alike=0.05).select("row_id", "merge_id", "merged")


@_on("w89_normalised", PARAS)
def _(p):
    return normalize.normalised_paragraphs(p.where("pdf_filename IS NOT NULL"))


@_on("x5_scored_links", META)
def _(m):
    return m.select("pdf_filename", "scraped_at", links.link_score(F.coalesce("pdf_url", F.lit(""))).alias("score"))


@_on("x6_image_names", PAGES)
def _(p):
    name = F.concat(F.regexp_replace("pdf_filename", r"\.pdf$", ""), F.when(F.col("page") > 1, F.concat(F.lit("_p"), F.format_string("%02d", "page"))).otherwise(""), F.lit("_cropped.png"))
    file, page = layout.parse_image_name(name)
    return p.where("pdf_filename IS NOT NULL AND page IS NOT NULL").select("page_id", file.alias("file"), page.alias("page"))


@_on("x12_prompt_texts", PARAS)
def _(p):
    return p.select("row_id", score.prompt(F.col("text"), "Contexto. ", "Clasifica: [{text}] Responde:").alias("prompt"))


@_on("x14_labels", SCORED)
def _(s):
    return s.groupBy("fiscal_risk_score", score.label(F.col("fiscal_risk_score")).alias("label")).agg(F.count("*").alias("n"))


@_on("x20_absolute", META)
def _(m):
    return m.select("pdf_filename", "scraped_at", links.absolute(F.regexp_replace("pdf_url", "^https?:", "")).alias("url"))


@_on("f21_pending_rows", SCORED)
def _(s):
    return score.pending(s).select("paragraph_num", "pdf_filename")


@_on("t8_batch_of_rows", SCORED)
def _(s):
    n = segment.number_rows(s.select("pdf_filename", "paragraph_num", "text").withColumn("t", F.md5(F.coalesce("text", F.lit("")))).drop("text"), ["pdf_filename", "paragraph_num", "t"], "n")
    return n.select("paragraph_num", "n", F.floor((F.col("n") - 1) / 100).alias("batch"))


@_on("a20_cost", PARAS)
def _(p):
    e = aggregate.cost_estimate(p, 2400)
    return e.withColumns({c: F.round(c, 3) for c in ("input_cost", "output_cost", "total_cost")})


@_on("k10_removal_summary", PAGES)
def _(p):
    s = scanned_clean.removal_summary(scanned_clean.removals(p), "2020-01-01")
    return s.select("total_removals", "total_chars_removed", F.size("by_reason").alias("reasons"), F.size("by_pdf").alias("files"), F.col("longest_removed.page_id").alias("longest_page"), F.aggregate("by_pdf", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("by_pdf_total"))


# Detail pages and words made of columns of the tables


@_on("f2_links", META)
def _(m):
    title = F.regexp_replace(F.coalesce("doc_title", F.lit("")), "[<>]", "")
    html = F.concat(F.lit('<p><a class="d" href="'), F.coalesce("pdf_url", F.lit("")), F.lit('"> <b>'), title, F.lit('</b> </a><a href="x.html">n</a></p>'))
    return links.extract_links(m.select("pdf_filename", "scraped_at", html.alias("html"))).select("pdf_filename", "scraped_at", "pos", "href", "label")


@_on("s1_listing", LIST)
def _(x):
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[<>]", "")
    html = F.concat(F.lit('<table><tr><td class="size100"><p>'), cell("date"), F.lit('</p></td><td><a href="'), F.coalesce("page_url", F.lit("")), F.lit('">'), cell("doc_title"), F.lit("</a></td></tr></table>"))
    return links.list_rows_from_html(x.select(html.alias("html"))).select("date", "doc_title", "page_url")


@_on("f7_resolved", META)
def _(m):
    html = F.concat(F.lit('<iframe width="1" src="'), F.regexp_replace(F.coalesce("pdf_url", F.lit("")), "^https?:", ""), F.lit('"></iframe>'))
    return m.select("pdf_filename", "scraped_at", links.resolve_url(html).alias("url"))


def _words(x):
    d = lambda c: F.col(c).cast("double")
    return x.select(
        F.col("l_suppkey").cast("string").alias("pdf_filename"), F.col("l_linenumber").cast("int").alias("page"), F.lit(7).alias("total_pages"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.col("l_orderkey").alias("seq"), F.col("l_returnflag").alias("text"), (F.lit(8.0) + d("l_quantity") % 5).alias("size"), F.floor(d("l_extendedprice") % 842).cast("double").alias("top"), (F.col("l_partkey") % 595).cast("double").alias("x0"), F.lit("F").alias("fontname"),
    )


@_on("f5_body_words", "lineitem")
def _(x):
    return layout.body_words(_words(x), left=30.0, right=50.0).groupBy("page", "text").agg(F.count("*").alias("n"), F.min("top").alias("first"), F.max("top").alias("last"))


@_on("w3_lines", "lineitem")
def _(x):
    return layout.lines(_words(x)).select("pdf_filename", "page", "top", "line", "left")


# Streams


def _stream(spark: SparkSession, d: str, name: str, schema: str):
    """A table of one file, or a folder of files, read as a stream where it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return ingest.folder(spark, f"{d}/{name}.parquet", schema)
    return ingest.folder(spark, d, schema, only=f"{name}.parquet")


def _work(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events_ingested(spark, d):
    w = _work(spark)
    ingest.append_available(_stream(spark, d, "events", ingest.EVENTS), f"{w}/out", f"{w}/state")
    return spark.read.schema(ingest.EVENTS).parquet(f"{w}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _pages_cleaned(spark, d):
    w = _work(spark)
    ingest.run_available(_stream(spark, d, PAGES, ingest.PAGES), f"{w}/out", f"{w}/state", lambda b: clean.clean_pages(b).select("page_id", "cleaned_length"))
    return spark.read.parquet(f"{w}/out").select("page_id", "cleaned_length")


def _event_windows(spark, d):
    w = _work(spark)
    s = ingest.windows(_stream(spark, d, "events", ingest.EVENTS))

    # Windows come out as they change; state of windows behind the watermark is given up.
    ingest.run_available(s, f"{w}/out", f"{w}/state", mode="update")
    return ingest.latest_updates(spark, f"{w}/out", ["event_type", "window_start"]).select("event_type", "window_start", "n", F.round("total", 2).alias("total"))


QUERIES |= {"st1_events_ingested": _events_ingested, "st2_pages_cleaned": _pages_cleaned, "st3_event_windows": _event_windows}
