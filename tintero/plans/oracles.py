"""SQL counterparts of the queries, for an engine with RE2 expressions.  White space is written out as Unicode has it."""

from __future__ import annotations

_S = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_C = _S[1:-1]  # the same inside a class
PAGES, PARAS = "scanned_pdfs_extracted_text", "unified_paragraphs_segmented"
_NL = "chr(10) || chr(10)"


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _sub(e: str, rules) -> str:
    """Nested replacements; a line feed in a replacement is written as such."""
    for p, to in rules:
        e = f"regexp_replace({e}, {_q(p)}, {_q(to)}, 'g')"
    return e


def _strip(e: str) -> str:
    return _sub(e, [(rf"^{_S}+|{_S}+$", "")])


_W = rf"[^{_C}]+"
_U = "A-ZÁÉÍÓÚÑ"


def _header(t: str) -> str:
    n = f"len(regexp_extract_all({t}, {_q(_W)}))"
    return f"({t} <> '' AND length({t}) < 150 AND {n} > 0 AND {n} < 20 AND regexp_matches({t}, '^\\p{{Lu}}') AND NOT regexp_matches({t}, '[.!?]$') AND NOT regexp_matches({t}, {_q(rf'^Lima,?{_S}+\p{{Nd}}{{1,2}}{_S}+de')}))"


def _label(t: str) -> str:
    pats = [rf"(?i)^(Gráfico|Tabla|Cuadro|Figura|Gráf|Tab){_S}+N?°?{_S}*\p{{Nd}}+", rf"^\p{{Nd}}+{_S}*:{_S}*.+", rf"^[IVXLCDM]+{_S}*[.:]", rf"^[A-Z]{_S}*\){_S}*.+"]
    one = " OR ".join(f"regexp_matches({t}, {_q(p)})" for p in pats)
    return f"({t} <> '' AND ({one} OR (regexp_matches({t}, {_q(rf'^[A-Z]{_S}*\.{_S}*.+')}) AND length({t}) < 100)))"


def _clean(e: str, aggressive: bool = False) -> list[str]:
    """Expressions of the steps over a column t."""
    drop = f"array_to_string(list_filter(string_split(t, {_NL}), lambda p: NOT ({_header(_strip('p'))} OR {_label(_strip('p'))})), {_NL})"
    steps = [
        _sub("t", [(rf"\n*[.…]{{5,}}[{_C}]*([{_U}][{_U}{_C}]+)(\n|$)", r"\2")]),
        _sub("t", [(rf"\n*Lima,?{_S}+\p{{Nd}}{{1,2}}{_S}+de{_S}+[\p{{L}}\p{{M}}\p{{Nd}}_]+{_S}+de{_S}+\p{{Nd}}{{4}}\.?{_S}*", "\n\n"), (rf"\n\n([{_U}][{_U}{_C}]{{10,}})\n\n", "\n\n")]),
        _sub("t", [(rf"\n\n([{_U}]+(?:{_S}+[{_U}]+){{2,}})\n\n", "\n\n")]), drop,
        _sub("t", [(rf"(?i)\n*(Gráfico|Tabla|Cuadro|Figura){_S}+N?°?{_S}*\p{{Nd}}+[^\n]*\n*", "\n")]),
        _sub("t", [(rf"\n+\([A-Z]\){_S}[^\n]+\([A-Z]\){_S}[^\n]*\n+", "\n"), (rf"\n+[A-Z]\){_S}[^\n]+[A-Z]\){_S}[^\n]*\n+", "\n"), (rf"\n+\([A-Z]\){_S}[^\n]{{1,50}}\n+", "\n")]),
        "replace(" + _sub("t", [("[•➢►■▪□◼○●▫Ø]", " ")]) + ", '…', '...')",
        _strip(_sub("t", [(rf"{_S}+([.,;:!?])", r"\1"), (" {2,}", " "), (r"\n{3,}", "\n\n")])),
    ]
    if aggressive:
        steps.append(_sub("t", [(rf"\n\n([a-z]|[ivxIVX]+|\p{{Nd}}+)\){_S}*\n\n", "\n\n")]))
    steps.append(_sub("t", [(r"\n\n([a-záéíóúñü])", r" \1"), (r"\n\n([12]\p{Nd}{3})", r" \1")]))
    return steps


def _cleaned(source: str, key: str, text: str, aggressive: bool = False) -> str:
    """WITH clauses ending in table k (key, o, t)."""
    out = f"WITH k0 AS (SELECT {key}, coalesce({text}, '') AS o, coalesce({text}, '') AS t FROM {source})"
    steps = _clean("t", aggressive)
    for i, s in enumerate(steps):
        out += f",\nk{i + 1} AS (SELECT {key}, o, {s} AS t FROM k{i})"
    return out + f",\nk AS (SELECT * FROM k{len(steps)})"


_DOC = "SELECT pdf_filename, date, avg(fiscal_risk_score) AS s, count(fiscal_risk_score) AS n FROM scored_paragraphs WHERE date IS NOT NULL AND date <> '' GROUP BY 1, 2 HAVING count(fiscal_risk_score) > 0"
_DATE = """coalesce(CASE WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(d, '%Y-%m-%d') END,
 CASE WHEN regexp_matches(d, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN try_strptime(d, '%d/%m/%Y') END,
 CASE WHEN regexp_matches(d, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$') THEN try_strptime(substr(d, 1, length(d) - 2) || '20' || right(d, 2), '%d/%m/%Y') END,
 CASE WHEN regexp_matches(d, '^[0-9]{1,2} de [a-z]+ de [0-9]{4}$') THEN make_timestamp(CAST(split_part(d, ' ', 5) AS BIGINT),
   CAST(list_position(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'], replace(split_part(d, ' ', 3), 'setiembre', 'septiembre')) AS BIGINT), CAST(split_part(d, ' ', 1) AS BIGINT), 0, 0, 0) END)::DATE"""
_LIST = f"(SELECT *, {_DATE} AS day FROM (SELECT *, lower(regexp_replace(trim(date), '\\s+', ' ', 'g')) AS d FROM list_rows))"
_DOCNUM = rf"(?i)(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}_])(Informe|Comunicado)(?:{_S}+CF)?(?:{_S}+(?:N[°ºo]|No))?{_S}*(\p{{Nd}}{{2,4}})"
_REASON = r"""CASE WHEN length(t) < 100 THEN 'too_short (' || length(t) || ' chars)' WHEN NOT regexp_matches(t, '^[\p{Lu}\p{Nd}]') THEN 'starts_lowercase'
 WHEN NOT regexp_matches(t, '[.!?)\]"%:]$') THEN 'no_ending_punctuation' WHEN length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 0.5 * length(t) THEN 'insufficient_text_content' END"""
_GRADED = f"(SELECT row_id, {_REASON} AS reason FROM (SELECT row_id, coalesce(text, '') AS t FROM {PARAS}))"
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_filename ORDER BY scraped_at DESC NULLS LAST) AS rn FROM cf_metadata WHERE pdf_filename IS NOT NULL) WHERE rn = 1)"
_WANTED = " + ".join(f"(lower({{}}) LIKE '%{w}%')::INT" for w in "comunicado informe nota reporte documento pronunciamiento".split())
_SHOW = " OR ".join(f"lower(coalesce({{}}, '')) LIKE '%{w}%'" for w in "ppt presentacion presentación diapositiva slides conferencia powerpoint".split())
_OPEN = [rf"\n\n{_S}*(?:(?:\p{{Nd}}+|[a-zA-Z]+)\.?{_S}*[—\-]?{_S}*)?['\"]?{_S}*{k}" for k in ("Opinión del Consejo Fiscal", "Opinión del CF", "Opinión de CF")]
_ANNEX = [rf"ANEX[O0]S?{_S}*:?", rf"Anex[o0]{_S}*:?", rf"AN{_S}*EX[O0]S?{_S}*:?"]


def _at(p: str, flags: str = "s") -> str:
    """Position (from 0) of the first match of a pattern in text, null where there is none."""
    flag = f"(?{flags})"
    return f"CASE WHEN regexp_matches(text, {_q(flag + p)}) THEN length(regexp_extract(text, {_q(flag + '^(.*?)' + p)}, 1)) END"


_GROUPED = "SELECT CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' ELSE {c} END AS {c}, count(*) AS paragraphs, count(DISTINCT pdf_filename) AS documents FROM scored_paragraphs GROUP BY 1"

ORACLES: dict[str, str] = {
    "a1_document_scores": "SELECT pdf_filename, date, round(avg(fiscal_risk_score), 6) AS avg_risk_score, count(fiscal_risk_score) AS n_paragraphs, round(avg(risk_index), 6) AS avg_risk_index, min(doc_title) AS doc_title, min(doc_type) AS doc_type, min(doc_number) AS doc_number, min(year) AS year, min(month) AS month, "
    + ", ".join(f"count(CASE WHEN fiscal_risk_score = {k} THEN text END) AS score_{k}" for k in range(1, 6))
    + ", round((3 - avg(fiscal_risk_score)) / 2, 6) AS tone_index FROM scored_paragraphs WHERE date IS NOT NULL AND date <> '' GROUP BY pdf_filename, date HAVING count(fiscal_risk_score) > 0",
    "a2_tone_index": "SELECT fiscal_risk_score AS score, count(*) AS n, (3 - fiscal_risk_score) / 2 AS tone FROM scored_paragraphs GROUP BY 1",
    "a6_score_counts": "SELECT fiscal_risk_score, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM scored_paragraphs)::DOUBLE, 6) AS pct FROM scored_paragraphs GROUP BY 1",
    "a7_corpus_tone": f"SELECT count(*) AS n_documents, round(avg(s), 6) AS mean_score, round(stddev_samp(s), 6) AS std_score, round(avg((3 - s) / 2), 6) AS mean_tone, round(stddev_samp((3 - s) / 2), 6) AS std_tone FROM ({_DOC})",
    "a8_reduction_summary": _cleaned(PAGES, "page_id", "text")
    + ", m AS (SELECT length(o) AS a, length(t) AS b, CASE WHEN length(o) > 0 THEN (length(o) - length(t)) / length(o)::DOUBLE * 100 ELSE 0 END AS r FROM k) SELECT count(*) AS n_rows, sum(a)::BIGINT AS original_chars, sum(b)::BIGINT AS cleaned_chars, round(CASE WHEN sum(a) > 0 THEN (sum(a) - sum(b)) / sum(a)::DOUBLE * 100 ELSE 0 END, 6) AS reduction_pct, round(avg(r), 6) AS mean_reduction_pct, count(*) FILTER (r > 5) AS n_significant FROM m",
    "a10_upper_median": f"WITH v AS (SELECT length(text) AS v FROM {PARAS} WHERE text IS NOT NULL) SELECT count(*) AS n, min(v)::INT AS min_value, max(v)::INT AS max_value, round(avg(v), 6) AS mean_value, list_sort(list(v))[count(*) // 2 + 1]::INT AS upper_median FROM v",
    "a12_length_profile": f"WITH v AS (SELECT length(text) AS n FROM {PARAS} WHERE text IS NOT NULL) SELECT count(*) AS n, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_pop(n), 6) AS std_pop, min(n)::INT AS min, max(n)::INT AS max, count(*) FILTER (n < 200) AS under_200, count(*) FILTER (n >= 200 AND n < 400) AS from_200, count(*) FILTER (n >= 400 AND n < 700) AS from_400, count(*) FILTER (n >= 700 AND n < 1000) AS from_700, count(*) FILTER (n >= 1000) AS from_1000, round(count(*) FILTER (n BETWEEN 400 AND 700) / count(*)::DOUBLE, 6) AS target_share FROM v",
    **{f"a13_by_{c}": _GROUPED.format(c=c) for c in ("doc_type", "source_type", "year")},
    "a15_rejection_reasons": f"WITH g AS (SELECT regexp_replace(reason, ' \\([0-9]+ chars\\)$', '') AS reason FROM {_GRADED} WHERE reason IS NOT NULL) SELECT reason, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM g)::DOUBLE, 6) AS pct FROM g GROUP BY 1",
    "a16_source_mix": f"SELECT source_type, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM {PARAS})::DOUBLE, 6) AS pct FROM {PARAS} GROUP BY 1",
    "a21_corpus_statistics": f"WITH v AS (SELECT pdf_filename, length(text) AS n FROM {PARAS} WHERE text IS NOT NULL) SELECT count(*) AS total_paragraphs, count(DISTINCT pdf_filename) AS total_documents, sum(n)::BIGINT AS total_characters, round(avg(n), 6) AS mean_length, median(n) AS median_length, round(stddev_samp(n), 6) AS std_samp, round(stddev_pop(n), 6) AS std_pop, min(n)::INT AS min_length, max(n)::INT AS max_length, "
    + ", ".join(f"round(quantile_cont(n, {p}), 6) AS p{int(p * 100)}" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    + " FROM v",
    "a22_typed_documents": "SELECT doc_type, count(*) AS paragraphs, count(DISTINCT pdf_filename) AS documents FROM scored_paragraphs WHERE doc_type IS NOT NULL GROUP BY 1",
    "a23_histogram": f"WITH v AS (SELECT length(text) AS v FROM {PARAS} WHERE text IS NOT NULL), b AS (SELECT greatest(1, ceil(max(v) / 200.0))::BIGINT AS b FROM v), s AS (SELECT unnest(range(0, (SELECT b FROM b))) AS bin) SELECT bin, (bin * 200) || '-' || ((bin + 1) * 200) AS label, (SELECT count(*) FROM v WHERE least(v // 200, (SELECT b FROM b) - 1) = bin) AS n FROM s",
    "a24_per_document": f"SELECT count(*) AS paragraphs, count(DISTINCT pdf_filename) AS documents, round(count(*) / count(DISTINCT pdf_filename)::DOUBLE, 1) AS per_document FROM {PARAS}",
    "a25_stage_counts": "SELECT pdf_type, count(*) AS n FROM cf_metadata GROUP BY 1",
    "a26_page_totals": f"SELECT count(*) AS pages, sum(length(coalesce(text, '')))::BIGINT AS chars, (sum(length(coalesce(text, ''))) // count(*))::BIGINT AS chars_per_page, count(DISTINCT pdf_filename) AS files FROM {PAGES}",
    "a27_rule_counts": _cleaned(PAGES, "page_id", "text")
    + f" SELECT sum(len(regexp_extract_all(o, {_q(rf'Lima,?{_S}+\p{{Nd}}{{1,2}}{_S}+de{_S}+[\p{{L}}\p{{M}}\p{{Nd}}_]+{_S}+de{_S}+\p{{Nd}}{{4}}')})))::BIGINT AS dates_before, sum(len(regexp_extract_all(t, {_q(rf'Lima,?{_S}+\p{{Nd}}{{1,2}}{_S}+de{_S}+[\p{{L}}\p{{M}}\p{{Nd}}_]+{_S}+de{_S}+\p{{Nd}}{{4}}')})))::BIGINT AS dates_after, sum(len(regexp_extract_all(o, '\\n\\n[a-záéíóúñü]')))::BIGINT AS breaks_before, sum(len(regexp_extract_all(t, '\\n\\n[a-záéíóúñü]')))::BIGINT AS breaks_after FROM k",
    "c_clean_pages": _cleaned(PAGES, "page_id", "text")
    + " SELECT page_id, t AS cleaned_text, length(o)::INT AS original_length, length(t)::INT AS cleaned_length, round(CASE WHEN length(o) > 0 THEN (length(o) - length(t)) / length(o)::DOUBLE * 100 ELSE 0 END, 6) AS reduction_pct FROM k",
    "c_clean_documents": _cleaned("documents", "doc_id", f"replace(text, chr(10), {_NL})", True) + " SELECT doc_id, t AS cleaned_text FROM k",
    "c4_headers": f"SELECT page_id, len(list_filter(string_split(text, {_NL}), lambda p: {_header('trim(p)')}))::INT AS n_headers, len(list_filter(string_split(text, {_NL}), lambda p: {_label('trim(p)')}))::INT AS n_labels FROM {PAGES} WHERE text IS NOT NULL",
    "n1_from_opinion": f"WITH h AS (SELECT *, CASE WHEN page >= 2 THEN coalesce({', '.join(f'CASE WHEN ({_at(p)}) > 200 THEN ({_at(p)}) END' for p in _OPEN)}) END AS a FROM {PAGES}), f AS (SELECT pdf_filename, min(page) AS fp FROM h WHERE a IS NOT NULL GROUP BY 1) SELECT page_id, CASE WHEN page = fp AND a IS NOT NULL THEN substr(text, a + 1) ELSE text END AS text FROM h LEFT JOIN f USING (pdf_filename) WHERE fp IS NULL OR page >= fp",
    "n2_without_annexes": "WITH h AS (SELECT *, coalesce("
    + ", ".join(f"CASE WHEN regexp_matches(text, {_q('(?is)^' + _S + '*' + p)}) THEN -1 ELSE ({_at(rf'\n\n{_S}*' + p, 'is')}) END" for p in _ANNEX)
    + f") AS a FROM {PAGES}), f AS (SELECT pdf_filename, min(page) AS fp FROM h WHERE a IS NOT NULL GROUP BY 1), j AS (SELECT *, CASE WHEN page = fp AND a IS NOT NULL THEN substr(text, 1, a) ELSE text END AS c FROM h LEFT JOIN f USING (pdf_filename) WHERE fp IS NULL OR page < fp OR (page = fp AND (a IS NULL OR a >= 0))) SELECT page_id, c AS text FROM j WHERE fp IS NULL OR page < fp OR trim(c) <> ''",
    "n3_without_letters": f"SELECT page_id FROM {PAGES} WHERE NOT coalesce(regexp_matches(text, {_q(rf'(?i)Carta{_S}+N[*°º]?{_S}*\p{{Nd}}')}), false)",
    "u1_tagged_union": f"SELECT CASE WHEN lower(pdf_filename) LIKE 'informe%' THEN 'scanned' ELSE 'editable' END AS source_type, count(*) AS n FROM {PAGES} GROUP BY 1",
    "w1_page_pairs": f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY pdf_filename ORDER BY page NULLS LAST, page_id) AS n FROM {PAGES}), g AS (SELECT pdf_filename, (n - 1) // 2 AS g, count(*) AS n_pages, list(page ORDER BY n) AS pg, list(text ORDER BY n) AS tx FROM p GROUP BY 1, 2) SELECT pdf_filename, CASE WHEN n_pages = 1 THEN pg[1]::VARCHAR ELSE pg[1] || '-' || pg[2] END AS page_range, CASE WHEN n_pages = 1 THEN tx[1] ELSE {_strip("coalesce(tx[1], '')")} || ' ' || {_strip("coalesce(tx[2], '')")} END AS text, n_pages FROM g",
    "w1i_open_pages": rf"WITH p AS (SELECT pdf_filename, row_number() OVER w AS n, lag(NOT regexp_matches(rtrim(coalesce(text, '')), '[.!?]\s*$')) OVER w AS o FROM {PAGES} WINDOW w AS (PARTITION BY pdf_filename ORDER BY page NULLS LAST, page_id)), s AS (SELECT *, sum(CASE WHEN n > 1 AND o THEN 0 ELSE 1 END) OVER (PARTITION BY pdf_filename ORDER BY n) AS g FROM p), u AS (SELECT pdf_filename, g, count(*) AS c FROM s GROUP BY 1, 2) SELECT pdf_filename, count(*) AS n_units, max(c) AS longest FROM u GROUP BY 1",
    "x8_paragraphs": f"WITH p AS (SELECT page_id, list_filter(list_transform(string_split(text, {_NL}), lambda s: {_strip('s')}), lambda s: s <> '') AS l FROM {PAGES}), q AS (SELECT page_id, list_filter(l, lambda s: length(s) >= 20) AS l FROM p), u AS (SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1)::INT AS position FROM q) SELECT page_id, position, text, length(text)::INT AS length FROM u",
    "w6_numbered_paragraphs": f"SELECT pdf_filename, row_id, row_number() OVER (ORDER BY pdf_filename, row_id) AS paragraph_num FROM {PARAS} WHERE length(text) >= 20",
    "w7_words_per_paragraph": f"SELECT row_id, CASE WHEN text IS NOT NULL THEN len(regexp_extract_all(text, {_q(_W)}))::INT END AS words FROM {PARAS}",
    "w11_first_documents": f"SELECT pdf_filename, min(paragraph_num) AS first_row FROM {PARAS} GROUP BY 1 ORDER BY 2, 1 LIMIT 8",
    "u4_distinct_texts": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY md5(lower(trim(text, ' ')))",
    "f12_graded": f"SELECT row_id, reason FROM {_GRADED}",
    "f12_valid": f"SELECT row_id FROM {_GRADED} WHERE reason IS NULL",
    "x1_enriched": f"SELECT day AS date, strftime(day, '%Y') AS year, month(day)::INT AS month, page_url, doc_title, nullif(upper(x[1:1]) || lower(x[2:]), '') AS doc_type, try_cast(nullif(regexp_extract(c, {_q(_DOCNUM)}, 2), '') AS INT) AS doc_number FROM (SELECT *, regexp_extract(c, {_q(_DOCNUM)}, 1) AS x FROM (SELECT *, trim({_sub('doc_title', [(_S + '+', ' ')])}) AS c FROM {_LIST}))",
    "x4_dates": f"SELECT day, count(*) AS n FROM {_LIST} GROUP BY 1",
    "j1_with_metadata": f"SELECT p.row_id, p.pdf_filename, CASE WHEN m.pdf_filename IS NULL THEN '' ELSE m.date::VARCHAR END AS date, CASE WHEN m.pdf_filename IS NULL THEN '' ELSE m.year END AS year, m.month, CASE WHEN m.pdf_filename IS NULL THEN '' ELSE m.pdf_type END AS pdf_type, CASE WHEN m.pdf_filename IS NULL THEN '' ELSE m.doc_title END AS doc_title, CASE WHEN m.pdf_filename IS NULL THEN '' ELSE m.doc_type END AS doc_type, m.doc_number FROM {PARAS} p LEFT JOIN {_LATEST} m USING (pdf_filename)",
    "j1_latest_metadata": f"SELECT pdf_filename, doc_title, scraped_at FROM {_LATEST}",
    "j3_new_rows": "SELECT page_url, doc_title FROM list_rows l WHERE NOT EXISTS (SELECT 1 FROM cf_metadata m WHERE m.page_url = l.page_url)",
    "j5_missing_files": f"SELECT DISTINCT pdf_filename FROM cf_metadata m WHERE pdf_filename IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {PAGES} p WHERE p.pdf_filename = m.pdf_filename) AND NOT EXISTS (SELECT 1 FROM {PARAS} p WHERE p.pdf_filename = m.pdf_filename)",
    "j6_typed": f"WITH e AS (SELECT DISTINCT pdf_filename FROM {PARAS} WHERE source_type = 'editable'), s AS (SELECT DISTINCT pdf_filename FROM {PAGES}) SELECT CASE WHEN pdf_filename IN (SELECT pdf_filename FROM s) THEN 'scanned' WHEN pdf_filename IN (SELECT pdf_filename FROM e) THEN 'editable' ELSE pdf_type END AS pdf_type, count(*) AS n FROM cf_metadata GROUP BY 1",
    "k7_without_denied": "SELECT pdf_filename, scraped_at FROM cf_metadata m WHERE NOT EXISTS (SELECT 1 FROM cf_metadata d WHERE d.pdf_type IS NULL AND d.pdf_filename = m.pdf_filename)",
    "u2_appended": "SELECT without_url, sum(n)::BIGINT AS n FROM (SELECT pdf_url IS NULL AS without_url, count(*) AS n FROM cf_metadata GROUP BY 1 UNION ALL SELECT true, count(*) FROM list_rows l WHERE NOT EXISTS (SELECT 1 FROM cf_metadata m WHERE m.page_url = l.page_url)) GROUP BY 1 HAVING sum(n) > 0",
    "t2_by_date": "SELECT date, pdf_filename FROM cf_metadata ORDER BY date NULLS LAST",
    "t5_first_unmatched": f"SELECT DISTINCT pdf_filename FROM {PARAS} p WHERE NOT EXISTS (SELECT 1 FROM cf_metadata m WHERE m.pdf_filename = p.pdf_filename) ORDER BY 1 LIMIT 10",
    "f4_with_url": "SELECT pdf_filename, scraped_at, string_split(pdf_url, '/')[-1] AS file FROM cf_metadata WHERE pdf_url IS NOT NULL",
    "f1_presentations": f"SELECT {_SHOW.replace('{}', 'doc_title')} AS presentation, count(*) AS n FROM list_rows GROUP BY 1",
    "t1_best_links": f"WITH l AS (SELECT page_url, pdf_url AS href, doc_title AS label, row_number() OVER (PARTITION BY page_url ORDER BY scraped_at, pdf_filename) AS pos FROM cf_metadata WHERE pdf_url IS NOT NULL AND page_url IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY (({_SHOW.replace('{}', 'href')}) OR ({_SHOW.replace('{}', 'label')}))::INT, {_WANTED.replace('{}', 'href')} DESC, pos) AS rn FROM l) SELECT page_url, href FROM r WHERE rn = 1",
    "x5_link_scores": f"SELECT ({_WANTED.replace('{}', chr(34) + 'u' + chr(34))})::INT AS score, count(*) AS n FROM (SELECT coalesce(pdf_url, '') AS u FROM cf_metadata) GROUP BY 1",
    "w5_event_sessions": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2",
    "w5_absolute_gaps": "WITH g AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) > 20 THEN 1 ELSE 0 END AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, sum(j)::BIGINT AS last_session FROM g GROUP BY 1",
    "s7_type_by_text": f"WITH g AS (SELECT pdf_filename, length(trim(coalesce(string_agg(text, '' ORDER BY page, text), ''), ' ')) AS n FROM {PAGES} GROUP BY 1) SELECT CASE WHEN n >= 20 THEN 'editable' ELSE 'scanned' END AS pdf_type, count(*) AS n FROM g GROUP BY 1",
    "x16_lateral_cuts": "SELECT p_partkey, CASE WHEN 265 >= p_partkey % 900 - 265 THEN 0 ELSE 265 END AS x1, CASE WHEN 265 >= p_partkey % 900 - 265 THEN (p_partkey % 900)::INT ELSE (p_partkey % 900 - 265)::INT END AS x2 FROM part",
    "x11_neighbour_cosine": "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 4) AS similarity FROM embeddings",
    "w8_chunks": "WITH s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 6) AS c FROM embeddings), t AS (SELECT label, avg(c) - 0.5 * stddev_pop(c) AS th, max(vec_id) AS lastv FROM s GROUP BY 1) SELECT s.label, coalesce(sum((c < th AND vec_id < lastv)::INT), 0)::BIGINT AS last_chunk, count(*) AS n FROM s JOIN t ON s.label = t.label GROUP BY 1",
    "w9_merged": f"WITH r AS (SELECT pdf_filename, row_id, length(text) AS n, lead(length(text)) OVER (PARTITION BY pdf_filename ORDER BY row_id) AS m FROM {PARAS} WHERE text IS NOT NULL), f AS (SELECT *, coalesce(n < 200 AND n + m <= 1000, false) AS can FROM r), g AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY pdf_filename, can ORDER BY row_id) AS isl FROM f WINDOW w AS (PARTITION BY pdf_filename ORDER BY row_id)), h AS (SELECT *, can AND row_number() OVER (PARTITION BY pdf_filename, can, isl ORDER BY row_id) % 2 = 1 AS st FROM g), k AS (SELECT *, coalesce(lag(st) OVER w, false) AS tk, lag(row_id) OVER w AS pr FROM h WINDOW w AS (PARTITION BY pdf_filename ORDER BY row_id)) SELECT row_id, CASE WHEN tk THEN pr ELSE row_id END AS merge_id, st OR tk AS merged FROM k",
    "f21_pending": "SELECT pdf_filename, count(*) AS n FROM scored_paragraphs WHERE fiscal_risk_score IS NULL GROUP BY 1",
    "x12_prompts": f"SELECT row_id, (length('Contexto. Clasifica: \"\"\"\"\"\" Responde:') + length(coalesce(text, '')))::INT AS prompt_chars FROM {PARAS}",
    "x13_replies": "SELECT event_id, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[1-5]$') THEN json_extract_string(props, '$.k')::INT END AS score FROM events",
    "t8_batches": "WITH n AS (SELECT paragraph_num, row_number() OVER (ORDER BY pdf_filename, paragraph_num, md5(coalesce(text, ''))) AS n FROM scored_paragraphs) SELECT (n - 1) // 100 AS batch, count(*) AS n_rows, min(paragraph_num) AS first_num FROM n GROUP BY 1",
    "st1_events_ingested": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "st2_pages_cleaned": _cleaned(PAGES, "page_id", "text") + " SELECT page_id, length(t)::INT AS cleaned_length FROM k",
    "st3_event_windows": "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "f19_defaults": f"SELECT page_id, coalesce(pdf_filename, '') AS pdf_filename, coalesce(page, 0) AS page, length(coalesce(text, ''))::INT AS chars FROM {PAGES}",
    "f22_significant": _cleaned(PAGES, "page_id", "text") + " SELECT page_id FROM k WHERE length(o) > 0 AND (length(o) - length(t)) / length(o)::DOUBLE * 100 > 5",
    "j7_unsegmented_pages": f"SELECT pdf_filename, count(*) AS pages FROM {PAGES} p WHERE NOT EXISTS (SELECT 1 FROM {PARAS} q WHERE q.pdf_filename = p.pdf_filename) GROUP BY 1",
    "j8_rejects_of_main_reasons": f"WITH g AS (SELECT row_id, regexp_replace(reason, ' \\([0-9]+ chars\\)$', '') AS r FROM {_GRADED} WHERE reason IS NOT NULL), m AS (SELECT r FROM g GROUP BY r ORDER BY count(*) DESC, r LIMIT 3) SELECT row_id FROM g WHERE r IN (SELECT r FROM m)",
    "t3_page_order": f"WITH u AS (SELECT pdf_filename, page, 'scanned' AS source_type FROM {PAGES} UNION ALL SELECT pdf_filename, try_cast(string_split(page_range, '-')[1] AS INT), 'editable' FROM {PARAS}) SELECT pdf_filename, source_type, min(page) AS first_page, count(*) AS n FROM u GROUP BY 1, 2",
    "t7_year_series": "SELECT year::INT AS year, count(*) AS paragraphs, round(avg(risk_index), 6) AS tone FROM scored_paragraphs WHERE year IS NOT NULL AND year <> '' GROUP BY 1 ORDER BY 1",
    "x19_formatted": f"SELECT source_type, format('{{:,}}', sum(length(coalesce(text, '')))::BIGINT) AS chars FROM {PARAS} GROUP BY 1",
}

# Staged cleaning of scanned texts.  The patterns are written out again in this dialect, look-around by plain captures.
_D, _WORDCH = r"\p{Nd}", r"[\p{L}\p{M}\p{Nd}_]"
_CONTINUES = "de del la el los las un una en con por para sobre al a ante bajo hacia mediante según tras entre sin desde hasta y e o u no".split()
_IN = ", ".join(f"'{w}'" for w in _CONTINUES)
_CONNECT = "de|del|la|el|los|las|un|una|en|con|por|para|que|se|y|o|su|sus|sobre|al|ha|han|desde|hasta|entre|sin|tras|ante|bajo|hacia|mediante|según|versus|vía|…|\\.\\.\\.|a"
_PRELIM = _strip(_sub("text", [(rf"^[Ii]nforme{_S}+N[*°º]?{_S}*{_D}{{3,4}}[-{_C}]*{_D}{{4}}[-{_C}]*CF{_S}+".replace("^[Ii]nforme", "(?i)^informe"), ""), (r" +([<>;:?!,.)\]}])", r"\1"), (r"([(\[{]) +", r"\1"), (" {2,}", " "), (r" +\n", "\n"), (r"\n +", "\n")]))
_JOINED = _sub("text", [(r"\n\n([a-záéíóúñü])", r" \1"), (rf"\n\n([12]{_D}{{3}})", r" \1"), (rf"\n\n((?:{_CONNECT}){_S})", r" \1"), (rf"\n\n(N[*°{_C}]?{_D})", r" \1"), (r"\n\n(…|\.\.\.)", r" \1"), (rf"\n\n({_D}+[,.]?{_D}*{_S}*(?:por{_S}+ciento|%)?)", r" \1")])
_LAST = f"lower(regexp_extract(s, {_q(rf'({_W}){_S}*$')}, 1))"


def _heading(t: str) -> str:
    """A heading in scanned text."""
    words = f"regexp_extract_all({t}, {_q(_W)})"
    last = f"regexp_replace(lower({words}[-1]), '[.,;:!?]+$', '')"
    opens = rf"(regexp_matches({t}, '^[\p{{Lu}}\p{{Nd}}]') OR regexp_matches({t}, {_q(rf'(?i)^[ivxlcdmh]+{_S}*[.—:-]')}))"
    ends = rf"(NOT regexp_matches({t}, {_q(rf'\.{_S}*$')}) OR len({words}) < 8 OR regexp_matches({t}, {_q(rf'[!?]\.{_S}*$')}))"
    return f"(length({t}) < 200 AND {opens} AND NOT regexp_matches({t}, {_q(rf'(?i)^Lima,?{_S}+{_D}{{1,2}}{_S}+de')}) AND NOT starts_with({t}, 'El presente informe') AND len({words}) BETWEEN 1 AND 34 AND {last} NOT IN ({_IN}) AND {ends})"


_N = rf"[IVXLH]{{1,4}}\.?{_S}*[-—]?{_S}*"
_TITLES = "|".join(f"(?:^(?:{_N})?{t}$)" for t in (rf"Conclusiones?(?:{_S}+y{_S}+recomendaciones)?", "Riesgos?", "Antecedentes?", "Introducción"))


def _head(p: str) -> str:
    t = _strip(p)
    return f"({t} <> '' AND ({_heading(t)} OR {_label(t)} OR regexp_matches({t}, {_q('(?i)' + _TITLES)})))"


_SHORT = [
    rf"^{_D}+{_S}*/{_S}*{_D}+$", rf"^Lima,{_S}+{_D}+{_S}+de{_S}+{_WORDCH}+{_S}+de{_S}+{_D}{{4}}[^\n]*$", rf"^Informe{_S}+N[*°º]?{_S}*{_D}{{3,4}}[-{_C}]*CF[{_C}.]*$", rf"^PRESIDENTE{_S}+DEL{_S}+CONSEJO{_S}+FISCAL[{_C}.]*$", rf"^Presidente{_S}+(?:del{_S}+)?Consejo{_S}+Fiscal[{_C}.]*$", rf"^Conclusiones?{_S}*:?[{_C}.]*$", rf"^ANEXO{_S}*:?[{_C}.]*$",
]
_COUNT = lambda cls: f"length(regexp_replace(p, '[^{cls}]', '', 'g'))"
_DATED = _sub("text", [
    (rf"(?i)Lima,{_S}+{_D}{{1,2}}{_S}+de{_S}+{_WORDCH}+{_S}+de{_S}+{_D}{{4}}[^A-Z]*\n\n[{_U}{_C}]+(?:Presidente|PRESIDENTE)[^\n]*", ""), (rf"(?mi)Lima,{_S}+{_D}{{1,2}}{_S}+de{_S}+{_WORDCH}+{_S}+de{_S}+{_D}{{4}}[^.]*?[{_U}][{_U}{_C}]{{10,}}$", ""),
])
_NOISE = f"""CASE WHEN regexp_matches(p, {_q(rf'(?i)PRESIDENTE{_S}+DEL{_S}+CONSEJO{_S}+FISCAL[^\n]*?{_D}+/{_D}+[^\n]*?Av\.')}) OR regexp_matches(p, {_q(rf'{_D}+/{_D}+{_S}+Av\.{_S}+')}) THEN 'signature_address'
 WHEN length(p) < 100 AND ({' OR '.join(f"regexp_matches(p, {_q('(?i)' + x)})" for x in _SHORT)}) THEN 'exact_noise' WHEN length(p) < 30 THEN 'too_short'
 WHEN length(p) < 100 AND {_COUNT(chr(92) + 'p{L}')} > 10 AND {_COUNT(chr(92) + 'p{Lu}')} > 0.6 * {_COUNT(chr(92) + 'p{L}')} AND (regexp_matches(lower(p), 'presidente|consejo|fiscal') OR (len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^(?:\\p{{Lu}}|[^\\p{{L}}])'))) = 0)) THEN 'capitals'
 WHEN length(p) < 100 AND regexp_matches(p, {_q(rf'^[{_U}{_C}]{{15,}}[?%<>°º*{_C}]*$')}) THEN 'name_garbage' END"""
_PARTS = f"p0 AS (SELECT page_id, pdf_filename, page, list_filter(list_transform(string_split({_DATED}, {_NL}), lambda s: {_strip('s')}), lambda s: s <> '') AS l FROM {PAGES}), p1 AS (SELECT page_id, pdf_filename, page, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS pos FROM p0), p2 AS (SELECT *, regexp_extract_all(p, {_q(_W)}) AS w FROM p1), p3 AS (SELECT *, {_NOISE} AS reason FROM p2)"
_AUDIT = f"WITH {_PARTS}, a AS (SELECT page_id, pdf_filename, pos, p, reason, length(p) AS c, CASE WHEN {_COUNT(chr(92) + 'p{L}')} > 0 THEN {_COUNT(chr(92) + 'p{Lu}')} / {_COUNT(chr(92) + 'p{L}')}::DOUBLE ELSE 0 END AS caps FROM p3 WHERE reason IS NOT NULL)"
_LEFT = _strip(_sub("p", [(rf"{_S}*\({_S}*\)", ""), (rf"{_S}*\[{_S}*\]", ""), (r"[*]{2,}", ""), (r"[?]{2,}", "?"), (r"[!]{2,}", "!"), (r"[_|]+", ""), (" {2,}", " ")]))
_SIM = "round(list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY {g} ORDER BY {o})), 6)"
_TIMES = lambda ws: " + ".join(f"(length(l) - length(replace(l, '{w}', ''))) // {len(w)}" for w in ws)
_BAD, _GOOD = ("riesgo", "deterioro", "incumpl", "desviaci", "insosten", "déficit", "erosion", "adverso"), ("cumplimiento", "consolidación", "transparen", "prudente", "estable", "superávit")
_OPENINGS = ["Sin embargo", "No obstante", "Por otro lado", "Asimismo", "Además", "Por lo tanto", "En consecuencia", "De esta manera", "Por otra parte", "En este sentido", "Cabe mencionar"]
_SENTS = f"s AS (SELECT row_id, string_split(regexp_replace(text, {_q(r'([.!?])[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0b' + chr(92) + 'f' + chr(92) + 'r]+')}, {_q(chr(92) + '1' + chr(1))}, 'g'), chr(1)) AS l FROM {PARAS} WHERE {{where}})"

ORACLES |= {
    "n0_preliminary": f"SELECT page_id, {_PRELIM} AS text FROM {PAGES}",
    "n4_false_breaks": f"WITH j AS (SELECT page_id, list_filter(list_transform(string_split({_JOINED}, {_NL}), lambda s: {_strip('s')}), lambda s: s <> '') AS l FROM {PAGES} WHERE text IS NOT NULL), u AS (SELECT page_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM j), k AS (SELECT *, coalesce(lag({_LAST}) OVER (PARTITION BY page_id ORDER BY i) IN ({_IN}) AND regexp_matches(s, '^\\p{{Lu}}'), false) AS jn FROM u), g AS (SELECT *, sum((NOT jn)::INT) OVER (PARTITION BY page_id ORDER BY i) AS g FROM k), h AS (SELECT page_id, g, string_agg(s, ' ' ORDER BY i) AS t FROM g GROUP BY 1, 2), r AS (SELECT page_id, string_agg(t, {_NL} ORDER BY g) AS t FROM h GROUP BY 1) SELECT p.page_id, CASE WHEN p.text IS NOT NULL THEN coalesce(r.t, '') END AS text FROM {PAGES} p LEFT JOIN r USING (page_id)",
    "n5_headings": f"WITH k AS (SELECT page_id, string_split(text, {_NL}) AS l FROM {PAGES}), f AS (SELECT page_id, list_filter(l, lambda p, i: NOT (i % 2 = 0 AND i < len(l) AND {_head('p')})) AS l FROM k) SELECT page_id, array_to_string(CASE WHEN len(l) > 1 AND {_head('l[1]')} THEN l[2:] ELSE l END, {_NL}) AS text FROM f",
    "n6_noise": f"WITH {_PARTS}, k AS (SELECT page_id, pos, {_LEFT} AS t FROM p3 WHERE reason IS NULL), r AS (SELECT page_id, string_agg(t, {_NL} ORDER BY pos) AS t FROM k WHERE t <> '' GROUP BY 1) SELECT p.page_id, CASE WHEN p.text IS NOT NULL THEN coalesce(r.t, '') END AS text FROM {PAGES} p LEFT JOIN r USING (page_id)",
    "a17_removals_by_reason": _AUDIT + " SELECT reason, count(*) AS n, sum(c)::BIGINT AS chars, list(p ORDER BY page_id, pos)[1:5] AS examples FROM a GROUP BY 1",
    "a18_removals_by_file": _AUDIT + " SELECT pdf_filename, count(*) AS n, sum(c)::BIGINT AS chars FROM a GROUP BY 1",
    "a19_longest_removal": _AUDIT + " SELECT page_id, pos::INT AS pos, p AS paragraph, reason FROM a ORDER BY c DESC, page_id, pos LIMIT 1",
    "a29_removal_flags": _AUDIT + " SELECT CASE reason WHEN 'capitals' THEN 'capitals' WHEN 'too_short' THEN 'short' ELSE 'pattern' END AS category, count(*) AS n, round(avg(caps), 6) AS caps_ratio FROM a GROUP BY 1",
    "t4_most_removals": _AUDIT + " SELECT pdf_filename, count(*) AS n, sum(c)::BIGINT AS chars FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "k10_removal_summary": _AUDIT + " SELECT count(*) AS total_removals, sum(c)::BIGINT AS total_chars_removed, count(DISTINCT reason)::INT AS reasons, count(DISTINCT pdf_filename)::INT AS files, (SELECT page_id FROM a ORDER BY c DESC, page_id, pos LIMIT 1) AS longest_page, count(*) AS by_pdf_total FROM a",
    "f15_before_annex": f"WITH h AS (SELECT *, coalesce(regexp_matches(text, {_q(rf'(?i)^{_S}*ANEXOS?(?:{_S}+(?:[IVXLCDM]+|{_D}+))?{_S}*:?')}), false) AS o, {_at(rf'(?:^|\n) *Anexos?(?:[^\p{{L}}\p{{M}}\p{{Nd}}_]|$)', 'is')} AS q FROM {PAGES}), m AS (SELECT *, CASE WHEN q IS NOT NULL AND substr(text, q + 1, 1) = chr(10) THEN q + 1 ELSE q END AS p FROM h), f AS (SELECT pdf_filename, min(page) AS fp FROM m WHERE o OR p IS NOT NULL GROUP BY 1), j AS (SELECT page_id, page, fp, CASE WHEN page = fp AND p IS NOT NULL THEN rtrim(substr(text, 1, p), ' ') ELSE text END AS text FROM m LEFT JOIN f USING (pdf_filename) WHERE fp IS NULL OR page < fp OR (page = fp AND NOT o)) SELECT page_id, text FROM j WHERE fp IS NULL OR page < fp OR text <> ''",
    "v5_scored": f"WITH t AS (SELECT paragraph_num, fiscal_risk_score AS f, text, lower(coalesce(text, '')) AS l FROM scored_paragraphs WHERE fiscal_risk_score IS NULL), d AS (SELECT paragraph_num, f, l, ({_TIMES(_BAD)}) - ({_TIMES(_GOOD)}) AS d FROM t), r AS (SELECT paragraph_num, CASE WHEN l <> '' THEN greatest(1, least(5, 3 + (d > 0)::INT + (d > 2)::INT - (d < 0)::INT - (d < -2)::INT)) END AS s FROM d) SELECT paragraph_num, s::INT AS fiscal_risk_score, (3 - s) / 2.0 AS risk_index FROM r",
    "w10_word_chunks": f"WITH RECURSIVE {_SENTS.format(where='text IS NOT NULL')}, r AS (SELECT row_id, l, 1 AS i, 0 AS chunk, '' AS cur, 0 AS n, NULL::VARCHAR AS done FROM s UNION ALL SELECT row_id, l, i + 1, CASE WHEN ov THEN chunk + 1 ELSE chunk END, CASE WHEN ov OR cur = '' THEN x ELSE cur || ' ' || x END, CASE WHEN ov THEN k ELSE n + k END, CASE WHEN ov THEN cur END FROM (SELECT *, l[i] AS x, len(regexp_extract_all(l[i], {_q(_W)})) AS k, n + len(regexp_extract_all(l[i], {_q(_W)})) > 100 AND cur <> '' AND NOT ({' OR '.join(f"starts_with(l[i], '{o}')" for o in _OPENINGS)}) AS ov FROM r WHERE i <= len(l))) SELECT row_id, (chunk - 1)::INT AS chunk, done AS text FROM r WHERE done IS NOT NULL UNION ALL SELECT row_id, chunk::INT, cur FROM r WHERE i = len(l) + 1 AND cur <> ''",
    "w8_packed": f"WITH RECURSIVE {_SENTS.format(where='length(text) > 1000')}, r AS (SELECT row_id, l, 2 AS i, 0 AS chunk, l[1] AS cur, NULL::VARCHAR AS done FROM s UNION ALL SELECT row_id, l, i + 1, CASE WHEN ov THEN chunk + 1 ELSE chunk END, CASE WHEN ov THEN l[i] ELSE cur || ' ' || l[i] END, CASE WHEN ov THEN cur END FROM (SELECT *, length(cur) + length(l[i]) > 700 AS ov FROM r WHERE i <= len(l))) SELECT row_id, (chunk - 1)::INT AS chunk, done AS text FROM r WHERE done IS NOT NULL UNION ALL SELECT row_id, chunk::INT, cur FROM r WHERE i = len(l) + 1",
    "s7_types_by_file": f"WITH t AS (SELECT pdf_filename, page, substr(text, 1, 4) AS t FROM {PAGES}), g AS (SELECT pdf_filename, {_strip("coalesce(string_agg(coalesce(t, ''), '' ORDER BY page, t), '')")} AS t FROM t GROUP BY 1) SELECT pdf_filename, CASE WHEN length(t) >= 20 THEN 'editable' ELSE 'scanned' END AS pdf_type FROM g",
    "f1_by_document": f"SELECT doc_id, {_SHOW.replace('{}', 'text')} AS presentation FROM documents",
    "j5_missing_rows": f"SELECT pdf_filename, scraped_at FROM cf_metadata m WHERE pdf_filename IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scored_paragraphs s WHERE s.paragraph_num % 2 = 0 AND s.pdf_filename = m.pdf_filename) AND NOT EXISTS (SELECT 1 FROM {PAGES} p WHERE p.page > 3 AND p.pdf_filename = m.pdf_filename)",
    "j6_typed_rows": f"WITH e AS (SELECT DISTINCT pdf_filename FROM {PARAS} WHERE source_type = 'editable'), s AS (SELECT DISTINCT pdf_filename FROM {PAGES} WHERE page = 2) SELECT pdf_filename, scraped_at, CASE WHEN pdf_filename IN (SELECT pdf_filename FROM s) THEN 'scanned' WHEN pdf_filename IN (SELECT pdf_filename FROM e) THEN 'editable' ELSE pdf_type END AS pdf_type FROM cf_metadata",
    "j7_unsegmented_rows": f"SELECT page_id FROM {PAGES} p WHERE NOT EXISTS (SELECT 1 FROM {PARAS} q WHERE q.source_type = 'scanned' AND q.pdf_filename = p.pdf_filename)",
    "u1_tagged_rows": f"SELECT page_id, page, NULL::VARCHAR AS pdf_filename, 'scanned' AS source_type FROM {PAGES} WHERE lower(pdf_filename) LIKE 'informe%' UNION ALL SELECT page_id, NULL, pdf_filename, 'editable' FROM {PAGES} WHERE lower(pdf_filename) NOT LIKE 'informe%'",
    "u2_appended_rows": "SELECT page_url, doc_title, pdf_url FROM cf_metadata UNION ALL SELECT page_url, doc_title, NULL FROM list_rows l WHERE NOT EXISTS (SELECT 1 FROM cf_metadata m WHERE m.page_url = l.page_url)",
    "w1i_open_texts": rf"WITH p AS (SELECT pdf_filename, page, text, row_number() OVER w AS n, lag(NOT regexp_matches(rtrim(coalesce(text, '')), '[.!?]\s*$')) OVER w AS o FROM {PAGES} WINDOW w AS (PARTITION BY pdf_filename ORDER BY page NULLS LAST, page_id)), s AS (SELECT *, sum(CASE WHEN n > 1 AND o THEN 0 ELSE 1 END) OVER (PARTITION BY pdf_filename ORDER BY n) AS g FROM p) SELECT pdf_filename, CASE WHEN count(*) = 1 THEN min(page)::VARCHAR ELSE arg_min(page, n) || '-' || arg_max(page, n) END AS page_range, CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg({_strip("coalesce(text, '')")}, ' ' ORDER BY n) END AS text, count(*) AS n_pages FROM s GROUP BY pdf_filename, g",
    "w8_chunk_rows": f"WITH s AS (SELECT vec_id, label, {_SIM.format(g='label', o='vec_id')} AS c FROM embeddings), t AS (SELECT *, coalesce((c < avg(c) OVER (PARTITION BY label) - 0.5 * stddev_pop(c) OVER (PARTITION BY label))::INT, 0) AS x FROM s) SELECT vec_id, label, coalesce(sum(x) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk FROM t",
    "w9_merged_by_similarity": f"WITH b AS (SELECT pdf_filename, row_id, length(text) AS n, {_SIM.format(g='pdf_filename', o='row_id')} AS c FROM {PARAS} JOIN embeddings ON vec_id = row_id WHERE text IS NOT NULL), r AS (SELECT *, lead(n) OVER (PARTITION BY pdf_filename ORDER BY row_id) AS m FROM b), f AS (SELECT *, coalesce(n < 400 AND n + m <= 1000 AND c >= 0.05, false) AS can FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY pdf_filename ORDER BY row_id) - row_number() OVER (PARTITION BY pdf_filename, can ORDER BY row_id) AS isl FROM f), h AS (SELECT *, can AND row_number() OVER (PARTITION BY pdf_filename, can, isl ORDER BY row_id) % 2 = 1 AS st FROM g), k AS (SELECT *, coalesce(lag(st) OVER w, false) AS tk, lag(row_id) OVER w AS pr FROM h WINDOW w AS (PARTITION BY pdf_filename ORDER BY row_id)) SELECT row_id, CASE WHEN tk THEN pr ELSE row_id END AS merge_id, st OR tk AS merged FROM k",
    "x5_scored_links": f"SELECT pdf_filename, scraped_at, ({_WANTED.replace('{}', chr(34) + 'u' + chr(34))})::INT AS score FROM (SELECT *, coalesce(pdf_url, '') AS u FROM cf_metadata)",
    "x6_image_names": f"SELECT page_id, regexp_replace(pdf_filename, '\\.pdf$', '') || '.pdf' AS file, CASE WHEN page > 1 THEN page ELSE 1 END AS page FROM {PAGES} WHERE pdf_filename IS NOT NULL AND page IS NOT NULL",
    "x12_prompt_texts": f"SELECT row_id, 'Contexto. Clasifica: [' || coalesce(text, '') || '] Responde:' AS prompt FROM {PARAS}",
    "x14_labels": "SELECT fiscal_risk_score, CASE fiscal_risk_score WHEN 1 THEN 'Sin preocupación fiscal' WHEN 2 THEN 'Leve preocupación' WHEN 3 THEN 'Neutral o técnico' WHEN 4 THEN 'Alta preocupación' WHEN 5 THEN 'Alarma fiscal' END AS label, count(*) AS n FROM scored_paragraphs GROUP BY 1, 2",
    "x20_absolute": "SELECT pdf_filename, scraped_at, CASE WHEN u LIKE '//%' THEN 'https:' || u ELSE u END AS url FROM (SELECT *, regexp_replace(pdf_url, '^https?:', '') AS u FROM cf_metadata)",
    "f21_pending_rows": "SELECT paragraph_num, pdf_filename FROM scored_paragraphs WHERE fiscal_risk_score IS NULL",
    "t8_batch_of_rows": "WITH n AS (SELECT paragraph_num, row_number() OVER (ORDER BY pdf_filename, paragraph_num, md5(coalesce(text, ''))) AS n FROM scored_paragraphs) SELECT paragraph_num, n, (n - 1) // 100 AS batch FROM n",
    "a20_cost": f"WITH t AS (SELECT count(*) AS n, ((sum(length(coalesce(text, ''))) + 2400 * count(*)) // 4)::BIGINT AS i FROM {PARAS}) SELECT n AS n_rows, i AS input_tokens, n * 5 AS output_tokens, round(i * 0.0025 / 1000, 3) AS input_cost, round(n * 5 * 0.01 / 1000, 3) AS output_cost, round(i * 0.0025 / 1000 + n * 5 * 0.01 / 1000, 3) AS total_cost FROM t",
    "f2_links": f"SELECT pdf_filename, scraped_at, 0 AS pos, pdf_url AS href, {_strip("regexp_replace(coalesce(doc_title, ''), '[<>]', '', 'g')")} AS label FROM cf_metadata WHERE lower(pdf_url) LIKE '%.pdf%'",
    "s1_listing": f"SELECT {_strip("regexp_replace(coalesce(date, ''), '[<>]', '', 'g')")} AS date, {_strip("regexp_replace(coalesce(doc_title, ''), '[<>]', '', 'g')")} AS doc_title, page_url FROM list_rows WHERE page_url <> ''",
    "f7_resolved": "SELECT pdf_filename, scraped_at, CASE WHEN lower(u) LIKE '%.pdf%' THEN CASE WHEN u LIKE '//%' THEN 'https:' || u ELSE u END END AS url FROM (SELECT *, regexp_replace(pdf_url, '^https?:', '') AS u FROM cf_metadata)",
    "f5_body_words": "WITH w AS (SELECT l_linenumber::INT AS page, l_returnflag AS text, 8.0 + l_quantity::DOUBLE % 5 AS size, floor(l_extendedprice::DOUBLE % 842) AS top, l_partkey % 595 AS x0 FROM lineitem) SELECT page, text, count(*) AS n, min(top) AS first, max(top) AS last FROM w WHERE size BETWEEN 10.5 AND 11.9 AND round_even(size, 1) NOT IN (9.5, 8.5, 8.4, 7.9, 7.0, 6.5, 6.0, 5.5) AND top > CASE WHEN page = 1 THEN 100 ELSE 70 END AND top < 842 - CASE WHEN page = 7 THEN 120 ELSE 85 END AND x0 > 30 AND x0 < 545 GROUP BY 1, 2",
    "w3_lines": "SELECT l_suppkey::VARCHAR AS pdf_filename, l_linenumber::INT AS page, floor(l_extendedprice::DOUBLE % 842) AS top, trim(string_agg(l_returnflag, ' ' ORDER BY l_partkey % 595, l_orderkey, l_returnflag), ' ') AS line, min(l_partkey % 595)::DOUBLE AS left FROM lineitem GROUP BY 1, 2, 3",
}
