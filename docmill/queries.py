"""Named queries over the driver's tables, each with the SQL of the same result.

The tables hold no contracts, so boundaries, families and policies are stood in for by rules over their own columns
(a line under 40 characters opens a clause, a source is a family); the operators are those of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import fixed, text
from docmill.functions.rules import cascade
from docmill.operators import joins, library, lifecycle, retrieve, review, rounds, structure
from docmill.operators.tasks import saved, scratch
from docmill.sources import docx, keyed, redline
from docmill.streaming import intake, waits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- intake -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_fingerprint(spark, sf):
    return library.fingerprints(table(spark, sf, "documents"), "text").select("doc_id", "sha256")


def _files(spark, sf):
    return library.fingerprints(table(spark, sf, "documents"), "text").select(F.col("doc_id").alias("path"), "doc_id", "source", "sha256")


_DUPS = "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'new' END AS status FROM documents"


@query(_DUPS)
def intake_exact_dups(spark, sf):
    files = _files(spark, sf)
    return library.flag_duplicates(files, files.limit(0), within=True).select("doc_id", "status")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0')")
def intake_known_hash(spark, sf):
    files = _files(spark, sf)
    return library.new_files(files, files.where("source = 'src0'")).select("doc_id")


@query(f"SELECT status, count(*) AS n FROM ({_DUPS}) GROUP BY status")
def batch_status_summary(spark, sf):
    return library.status_summary(intake_exact_dups(spark, sf))


_SLUG = "lower(trim(regexp_replace(regexp_replace(regexp_replace({}, '[\\[\\]().]+', '-', 'g'), '[_\\s]+', '-', 'g'), '-+', '-', 'g'), '-'))"


@query(f"SELECT p_partkey AS id, {_SLUG.format('p_name')} AS slug FROM part UNION ALL SELECT page_id, {_SLUG.format('url')} FROM pages")
def slug_ids(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.slug(F.col("p_name")).alias("slug"))
    return parts.union(table(spark, sf, "pages").select("page_id", text.slug(F.col("url"))))


@query("""SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/de/') THEN 'german' ELSE 'other' END AS family,
CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'anchor' ELSE '' END AS stage FROM pages""")
def classify_cascade(spark, sf):
    url = F.col("url")
    family = cascade(url, [("/en/", F.lit("english")), ("/fr/", F.lit("french")), ("/de/", F.lit("german"))], F.lit("other"))
    stage = cascade(url, [("?", F.lit("query")), ("#", F.lit("anchor"))], F.lit(""))
    return table(spark, sf, "pages").select("page_id", family.alias("family"), stage.alias("stage"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS md_lines, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count FROM documents")
def word_line_counts(spark, sf):
    body = F.col("text")
    # a break at the very end would begin no line here; these texts have none
    return table(spark, sf, "documents").select("doc_id", text.line_count(body).alias("md_lines"), text.word_count(body).alias("word_count"))


@query(
    """SELECT page_id, length(html) AS n_html, round(length(t) / length(html), 3) AS kept_ratio, (length(t) / length(html)) < 0.5 AS lost FROM (
SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM pages)"""
)
def extraction_loss(spark, sf):
    plain = F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", " "), r"\s+", " ")
    out = library.extraction_loss(table(spark, sf, "pages").withColumn("plain", plain), "html", "plain")
    return out.select("page_id", F.length("html").cast("long").alias("n_html"), F.round("kept_ratio", 3).alias("kept_ratio"), "lost")


# --- structure --------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, {_STRIP.format('line')} = '' AS blank FROM ({_LINES})")
def line_scan(spark, sf):
    return structure.lines(table(spark, sf, "documents")).select("doc_id", *long("line_no"), "line", "blank")


def short(x: Column) -> Column:
    """Stands in for the literal boundary patterns: the length rule alone."""
    return F.length(x) < fixed.SHORT_HEADER


def _cut(source: str, condition: str) -> str:
    """Clauses of the texts in ``source`` (doc_id, text), whose headers are the stripped lines for which ``condition`` holds."""
    lines = f"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {source}"
    return f"""b AS (SELECT doc_id, line_no, header FROM (SELECT doc_id, line_no, {_STRIP.format('line')} AS header FROM ({lines})) WHERE header <> '' AND ({condition})),
n AS (SELECT doc_id, len(string_split(text, chr(10))) AS total, string_split(text, chr(10)) AS l FROM {source}),
c AS (SELECT b.doc_id, header, line_no AS start_line, coalesce(lead(line_no) OVER w - 1, total) AS end_line, row_number() OVER w AS clause_no, l FROM b JOIN n USING (doc_id) WINDOW w AS (PARTITION BY b.doc_id ORDER BY line_no)),
s AS (SELECT doc_id, clause_no, header, start_line, end_line, {_STRIP.format("array_to_string(l[start_line:end_line], chr(10))")} AS body FROM c)"""


_CUT = _cut("documents", "length(header) < 40")


@query(f"WITH {_CUT} SELECT doc_id, 'clause-' || lpad(CAST(clause_no AS VARCHAR), 3, '0') AS clause_id, header, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, length(body) AS char_count FROM s")
def segment_clauses(spark, sf):
    rows = structure.clauses(table(spark, sf, "documents"), is_boundary=short, rules=[], governance=None, chapter=None)
    return rows.select("doc_id", "clause_id", "header", *long("start_line", "end_line", "char_count"))


#: Ordered rules over the tables' own vocabulary; the third can never win, for the first holds its word.
RULES = [("access", ["token", "key", "api"]), ("contact", ["@", "555-"]), ("tokens", ["token"]), ("table", [" | "]), ("quoted", ['"']), ("english", [" the ", "The "]), ("french", [" le ", " la "]), ("german", [" der ", " die "])]
_WHENS = " ".join("WHEN " + " OR ".join(f"contains(header, '{p}') OR contains(substr(body, 1, 200), '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in RULES)
_TYPED = f"{_CUT}, t AS (SELECT doc_id, clause_no, header, body, CASE {_WHENS} ELSE 'unmapped' END AS clause_type FROM s)"


def _clauses(spark, sf):
    return structure.clauses(table(spark, sf, "documents"), is_boundary=short, rules=RULES, governance=None, chapter=None)


@query(f"WITH {_TYPED} SELECT doc_id, 'clause-' || lpad(CAST(clause_no AS VARCHAR), 3, '0') AS clause_id, clause_type FROM t")
def clause_types(spark, sf):
    return _clauses(spark, sf).select("doc_id", "clause_id", "clause_type")


@query(f"WITH {_TYPED} SELECT doc_id, count(*) AS total_clauses, count(*) FILTER (clause_type = 'unmapped') AS unmapped_clauses, CAST(format('{{:.3f}}', count(*) FILTER (clause_type = 'unmapped') / count(*)) AS DOUBLE) AS unmapped_ratio FROM t GROUP BY doc_id")
def unmapped_ratio(spark, sf):
    return library.clause_stats(_clauses(spark, sf))


def _pages(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")


_PAGE_LINES = "SELECT page_id AS doc_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages"


@query(f"""WITH t AS (SELECT doc_id, line_no, unnest(regexp_extract_all({_STRIP.format('line')}, '"([^"]{{2,30}})"', 1)) AS term FROM ({_PAGE_LINES}))
SELECT doc_id, term, CAST(min(line_no) AS BIGINT) AS first_line FROM t GROUP BY doc_id, term""")
def defined_terms(spark, sf):
    return structure.defined_terms(_pages(spark, sf)).select("doc_id", "term", *long("first_line"))


_REFS = f"""SELECT doc_id, CAST(line_no AS BIGINT) AS from_line, unnest(regexp_extract_all(line, 'href="/[^"]*"', 0)) AS ref FROM ({_PAGE_LINES})"""


def _crossrefs(spark, sf):
    return structure.crossrefs(_pages(spark, sf), pattern='href="/[^"]*"').select("doc_id", *long("from_line"), "ref")


@query(_REFS)
def crossref_extract(spark, sf):
    return _crossrefs(spark, sf)


_TARGETS = """SELECT DISTINCT doc_id, h AS ref, 'sec-' || substr(h, 7, 1) AS section FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href="/[A-M][^"]*"', 0)) AS h FROM pages)"""


@query(f"SELECT r.doc_id, r.from_line, r.ref, t.section AS to_section, t.section IS NOT NULL AS resolved FROM ({_REFS}) r LEFT JOIN ({_TARGETS}) t ON r.doc_id = t.doc_id AND r.ref = t.ref")
def crossref_resolve(spark, sf):
    targets = structure.crossrefs(_pages(spark, sf), pattern='href="/[A-M][^"]*"').select("doc_id", "ref", F.concat(F.lit("sec-"), F.substring("ref", 7, 1)).alias("section"))
    return structure.resolve_refs(_crossrefs(spark, sf), targets).select("doc_id", "from_line", "ref", "to_section", "resolved")


@query(
    """SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email, regexp_matches(text, '\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}') AS phone,
regexp_matches(text, '(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]) ?[=:] ?.[A-Za-z0-9]{16,}') AS key, regexp_matches(text, '(?i)attorney[- ]client|privileged (and|&) confidential|work product') AS notice FROM documents"""
)
def privileged_scan(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in text.privileged(F.col("text")).items()))


@query("SELECT conv_id, turn, b AS before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE turn % 3 <> 1) WHERE turn - b <> 1")
def numbering_gaps(spark, sf):
    return structure.numbering_gaps(table(spark, sf, "conversations").where("turn % 3 <> 1").select("conv_id", "turn"), "conv_id", "turn")


# --- the library's own rules, on texts written like contracts ------------------------------------------------------

#: A contract of each document's own numbers, and then its own lines, as an expression that both engines read.
_CONTRACT = """concat('전문 "Preamble Term" 줄', chr(10), '제', doc_id % 4 + 1, '장 총칙 ', coalesce(lang, ''), chr(10), CASE doc_id % 7 WHEN 0 THEN '(정의)' WHEN 1 THEN '(통지)' WHEN 2 THEN '(비밀유지)' WHEN 3 THEN '(주주총회)' WHEN 4 THEN '(양도금지)' WHEN 5 THEN '(세금)' ELSE '(기타)' END, chr(10),
'본 계약에서 "', coalesce(source, ''), '" 및 "', coalesce(lang, ''), '" 그리고 "', coalesce(source, ''), '" 은 제', doc_id % 9 + 1, '조 및 제3조 참조', chr(10), '# 제목 "제목속" 제9조', chr(10), '(아주 긴 괄호 문장으로 시작하지만 마흔 자를 넘기 때문에 조문의 제목이 될 수 없는 줄입니다 정말로)', chr(10), '   ', chr(10),
repeat(concat('(조항 ', doc_id % 13, ')', chr(10), '  내용 ', coalesce(source, ''), '  ', chr(10)), CAST(doc_id % 6 AS INT)), CASE doc_id % 3 WHEN 0 THEN '' ELSE concat('별지 ', doc_id % 3, '. 목록', chr(10)) END, CASE doc_id % 2 WHEN 0 THEN '부록' ELSE '첨부..7 표' END, chr(10), coalesce(text, ''))"""
_CONTRACTS = f"(SELECT doc_id, {_CONTRACT} AS text FROM documents)"
_HEADING, _CHAPTER, _ARTICLE, _EXHIBIT = r"^(#{1,4})\s+(.+)", r"^제(\d+)장\s+(.+)", r"^\((.+?)\)", r"^(별지|부록|첨부)[\s.]*(\d*)"
_KINDS = f"""l AS (SELECT doc_id, line_no, {_STRIP.format('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {_CONTRACTS})),
k AS (SELECT *, regexp_matches(s, '{_HEADING}') AS heading, regexp_matches(s, '{_CHAPTER}') AS chapter, regexp_matches(s, '{_ARTICLE}') AND length(s) < 40 AS article, regexp_matches(s, '{_EXHIBIT}') AS exhibit FROM l WHERE s <> ''),
p AS (SELECT * FROM k WHERE NOT heading AND NOT chapter)"""
_OUTLINE = f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line, length(regexp_extract(s, '{_HEADING}', 1)) AS level, regexp_extract(s, '{_HEADING}', 2) AS text, NULL AS section FROM k WHERE heading UNION ALL
SELECT doc_id, CAST(line_no AS BIGINT), CASE WHEN chapter THEN 1 ELSE 2 END, CASE WHEN chapter THEN '제' || regexp_extract(s, '{_CHAPTER}', 1) || '장 ' || regexp_extract(s, '{_CHAPTER}', 2) ELSE regexp_extract(s, '{_ARTICLE}', 1) END,
CASE WHEN chapter THEN 'ch' || regexp_extract(s, '{_CHAPTER}', 1) ELSE 'art' || row_number() OVER (PARTITION BY doc_id ORDER BY line_no) END FROM k WHERE NOT heading AND (chapter OR article)"""
_FIRST_TERMS = """SELECT doc_id, term, CAST(min(line_no) AS BIGINT) AS first_line FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(s, '"([^"]{2,30})"', 1)) AS term FROM p) GROUP BY doc_id, term"""
_LABELS = f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line, CASE WHEN regexp_extract(s, '{_EXHIBIT}', 2) = '' THEN regexp_extract(s, '{_EXHIBIT}', 1) ELSE regexp_extract(s, '{_EXHIBIT}', 1) || ' ' || regexp_extract(s, '{_EXHIBIT}', 2) END AS label FROM p WHERE exhibit"""
_RULED = " ".join("WHEN " + " OR ".join(f"contains(header, '{w}') OR contains(substr(body, 1, 200), '{w}')" for w in words) + f" THEN '{name}'" for name, words in [fixed.GOVERNANCE, *fixed.CLAUSE_RULES])
_CONTRACT_CLAUSES = f"""{_cut(_CONTRACTS, f"(regexp_matches(header, '{_ARTICLE}') AND length(header) < 40) OR regexp_matches(header, '{_CHAPTER}') OR regexp_matches(header, '^(별지|부록|첨부)')")},
t AS (SELECT *, CASE WHEN regexp_matches(header, '^제\\d+장') THEN 'recitals' {_RULED} ELSE 'unmapped' END AS clause_type FROM s)"""


def _contracts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.expr(_CONTRACT).alias("text"))


@query(f"WITH {_KINDS} {_OUTLINE}")
def contract_outline(spark, sf):
    return structure.outline(_contracts(spark, sf)).select("doc_id", *long("line", "level"), "text", "section")


@query(f"WITH {_KINDS} {_FIRST_TERMS}")
def contract_terms(spark, sf):
    return structure.defined_terms(_contracts(spark, sf)).select("doc_id", "term", *long("first_line"))


@query(f"WITH {_KINDS} SELECT doc_id, CAST(line_no AS BIGINT) AS from_line, unnest(regexp_extract_all(s, '제(\\d+)조', 0)) AS ref FROM p")
def contract_refs(spark, sf):
    return structure.crossrefs(_contracts(spark, sf)).select("doc_id", *long("from_line"), "ref")


@query(f"WITH {_KINDS} {_LABELS}")
def contract_exhibits(spark, sf):
    return structure.exhibits(_contracts(spark, sf)).select("doc_id", *long("line"), "label")


@query(f"WITH {_CONTRACT_CLAUSES} SELECT doc_id, 'clause-' || lpad(CAST(clause_no AS VARCHAR), 3, '0') AS clause_id, header, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, clause_type, length(body) AS char_count FROM t")
def contract_clauses(spark, sf):
    return structure.clauses(_contracts(spark, sf)).select("doc_id", "clause_id", "header", *long("start_line", "end_line"), "clause_type", *long("char_count"))


_STAGED = "CASE doc_id % 4 WHEN 0 THEN 'early' WHEN 1 THEN 'mid' WHEN 2 THEN 'late' ELSE 'first' END"
_NAMED = "CASE doc_id % 9 WHEN 0 THEN 'sha-separated' WHEN 1 THEN 'safe-conditional-equity' WHEN 2 THEN 'convertible-bond' WHEN 3 THEN 'bond-with-warrants' WHEN 4 THEN 'rcps' WHEN 5 THEN 'convertible-preferred' WHEN 6 THEN 'common' WHEN 7 THEN 'memo' ELSE 'late-common' END"
_FILE_ID = f"concat(doc_id, '-', {_STAGED}, '-', {_NAMED}, CASE doc_id % 2 WHEN 0 THEN '-integrated' ELSE '-apart' END)"


def _title(pattern: str, bare: str | None, english: bool) -> str:
    """A title's pattern as SQL over ``stage``, ``stage_en``, ``form`` and ``form_en``."""
    stage, out = "stage_en" if english else "stage", "'" + pattern + "'"
    for name, value in (("{stage}", f"'[' || {stage} || '] '"), ("{form_en}", "form_en"), ("{form}", "form")):
        out = out.replace(name, f"' || {value} || '")
    return out if bare is None else f"CASE WHEN stage <> '' THEN {out} ELSE '{bare}' END"


_STAGE_OF = [" ".join(["CASE", *(f"WHEN contains(id, '{part}') THEN '{names[i]}'" for part, *names in fixed.STAGES), "ELSE '' END"]) for i in (0, 1)]
_FAMILY_OF = lambda value, other: " ".join(["CASE", *(f"WHEN contains(id, '{r[0]}') THEN {value(r)}" for r in fixed.FAMILIES), f"ELSE {other} END"])
_CLASSED = f"""x AS (SELECT *, {_STAGE_OF[0]} AS stage, {_STAGE_OF[1]} AS stage_en, CASE WHEN contains(id, '{fixed.FORMS[0]}') THEN '{fixed.FORMS[1][0]}' ELSE '{fixed.FORMS[2][0]}' END AS form, CASE WHEN contains(id, '{fixed.FORMS[0]}') THEN '{fixed.FORMS[1][1]}' ELSE '{fixed.FORMS[2][1]}' END AS form_en FROM (SELECT *, {_FILE_ID} AS id FROM documents)),
y AS (SELECT doc_id AS key, id, {_FAMILY_OF(lambda r: f"'{r[1]}'", f"'{fixed.OTHER_FAMILY[0]}'")} AS contract_family, {_FAMILY_OF(lambda r: f"'{r[2]}'", f"'{fixed.OTHER_FAMILY[1]}'")} AS subtype,
{_FAMILY_OF(lambda r: _title(r[3], r[5], False), "id || '.docx'")} AS title, {_FAMILY_OF(lambda r: _title(r[4], r[6], True), "''")} AS title_en, {_FAMILY_OF(lambda r: "'high'", "'low'")} AS classification_confidence FROM x)"""


def _classified(spark, sf):
    docs = _contracts(spark, sf).withColumn("key", F.col("doc_id")).withColumn("doc_id", F.expr(_FILE_ID))
    return library.classify(docs.withColumn("source_file", F.concat("doc_id", F.lit(".docx"))))


@query(f"WITH {_CLASSED} SELECT key, id AS doc_id, contract_family, subtype, title, title_en, classification_confidence FROM y")
def classify_documents(spark, sf):
    return _classified(spark, sf).select("key", "doc_id", "contract_family", "subtype", "title", "title_en", "classification_confidence")


_PARTS = f"""{_KINDS}, o AS ({_OUTLINE}), f AS ({_FIRST_TERMS}), e AS ({_LABELS}), {_CONTRACT_CLAUSES},
z AS (SELECT d.doc_id, coalesce(t.total, 0) AS total_clauses, coalesce(t.unmapped, 0) AS unmapped_clauses, coalesce(CAST(format('{{:.3f}}', t.unmapped / t.total) AS DOUBLE), 0) AS unmapped_ratio, coalesce(f.n, 0) AS defined_terms, coalesce(o.n, 0) AS sections, coalesce(e.n, 0) AS exhibits FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (clause_type = 'unmapped') AS unmapped FROM t GROUP BY doc_id) t ON d.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) f ON d.doc_id = f.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id) o ON d.doc_id = o.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id) e ON d.doc_id = e.doc_id)"""


@query(f"WITH {_PARTS} SELECT * FROM z")
def document_stats(spark, sf):
    return library.document_stats(_contracts(spark, sf)).select("doc_id", "stats.*")


@query(
    f"""WITH {_PARTS}, {_CLASSED}, v AS (SELECT *, concat_ws('; ', CASE WHEN unmapped_ratio > 0.3 THEN 'Unmapped clause ratio ' || format('{{:.1f}}', unmapped_ratio * 100) || '% exceeds 30%' END, CASE WHEN classification_confidence = 'low' THEN 'Low classification confidence' END,
CASE WHEN total_clauses < 5 THEN 'Only ' || total_clauses || ' clauses detected' END) AS soft FROM z JOIN y ON z.doc_id = y.key)
SELECT key, id AS doc_id, title, contract_family, soft AS soft_fails, CASE WHEN soft <> '' THEN 'staging' ELSE 'approved' END AS approval_state FROM v"""
)
def ingest_manifests(spark, sf):
    """The whole way of an ingest: classification, counts, manifest, validation and gate."""
    rows = library.document_stats(_classified(spark, sf)).withColumn("sha256", F.sha2("text", 256))
    keys = rows.select("key", "doc_id")
    made = library.gate(library.validate(library.manifest(rows, "2024-01-01T00:00:00"), enums=True))
    out = made.join(keys, "doc_id")
    return out.select("key", "doc_id", "title", "contract_family", F.array_join("soft_fails", "; ").alias("soft_fails"), "approval_state")


_FILE_NAME = "concat('[', CASE length(text) % 3 WHEN 0 THEN '초기' WHEN 1 THEN '중기' ELSE '후기' END, '] ', doc_id % 5, '.투자계약서_', CASE length(text) % 4 WHEN 0 THEN '상환전환우선주식' WHEN 1 THEN '전환우선주식' WHEN 2 THEN '보통주식' ELSE '신주인수권부사채' END, '(', CASE doc_id % 2 WHEN 0 THEN '통합형' ELSE '분리형' END, ')', CASE doc_id % 2 WHEN 0 THEN '_2309개정' ELSE '' END, '.docx')"
_STEM = f"regexp_replace(regexp_replace({_FILE_NAME}, '\\.[^.]*$', ''), '{fixed.SLUG_SUFFIX}', '')"
for _word, _by in fixed.SLUG_WORDS:
    _STEM = f"replace({_STEM}, '{_word}', '{_by}')"


@query(f"SELECT doc_id AS key, {_SLUG.format(_STEM)} AS doc_id FROM documents")
def file_doc_ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), library.doc_id(F.expr(_FILE_NAME)).alias("doc_id"))


@query("SELECT doc_id, CAST(format('{:.3f}', length(text) / 16) AS DOUBLE) AS ratio, format('{:.1f}', length(text) / 16 / 100 * 100) || '%' AS percent FROM documents")
def half_even(spark, sf):
    x = F.length("text") / 16
    return table(spark, sf, "documents").select("doc_id", text.rounded(x).alias("ratio"), text.percent(x / 100).alias("percent"))


_TAGS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h\\d|/tr)\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TAGS = f"replace({_TAGS}, '{_name}', '{_char}')"


_LAID_OUT = _STRIP.format(f"regexp_replace(regexp_replace({_TAGS}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')")


@query(f"SELECT page_id, {_LAID_OUT} AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


#: Every line behind a label of its own: a chapter, a paragraph or an item, whose number hangs on the line.
_LABELLED = f"(SELECT doc_id, line_no, line, CASE line_no % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS level, line_no // 4 % 5 + length(line) % 2 + 1 AS number FROM ({_LINES}))"


@query(
    f"""WITH l AS (SELECT *, count(*) FILTER (level < 3) OVER w AS n3, count(*) FILTER (level < 4) OVER w AS n4 FROM {_LABELLED} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, level, CASE level WHEN 1 THEN 0 WHEN 3 THEN n3 ELSE n4 END ORDER BY line_no) AS before FROM l)
SELECT doc_id, CAST(line_no AS BIGINT) AS line, level, CAST(number AS BIGINT) AS number, CAST(before AS BIGINT) AS before,
CASE WHEN before IS NULL AND number = 1 THEN 'first' WHEN before IS NULL THEN 'gap' WHEN number = before + 1 THEN 'next' WHEN number = before THEN 'repeat' WHEN number = 1 THEN 'restart' WHEN number > before THEN 'gap' ELSE 'back' END AS kind FROM b"""
)
def list_numbering(spark, sf):
    """Gaps, restarts and repeats of nested lists."""

    def label(x, i):
        n = (F.floor((i + 1) / 4) % 5 + F.length(x) % 2 + 1).cast("int").cast("string")
        return F.when((i + 1) % 3 == 0, F.concat(F.lit("제"), n, F.lit("장 "), x)).when((i + 1) % 3 == 1, F.concat(F.lit("("), n, F.lit(") "), x)).otherwise(F.concat(n, F.lit(". "), x))

    docs = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(structure.lines_of(F.col("text")), label), "\n").alias("text"))
    return structure.numbering(docs).select("doc_id", *long("line"), F.col("level"), *long("number", "before"), "kind")


@query(
    f"""WITH RECURSIVE l AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM (SELECT doc_id, line_no, length(line) + 1 AS len, {_STRIP.format('line')} <> '' AND length({_STRIP.format('line')}) < 40 AS head FROM ({_LINES}))),
z AS (SELECT *, sum(len) OVER (PARTITION BY doc_id, sec) > 500 AS big FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS u FROM (SELECT doc_id, sec, big, min(line_no) AS a, max(line_no) AS b, sum(len) AS len FROM z GROUP BY doc_id, sec, big, CASE WHEN big THEN line_no END)),
r AS (SELECT doc_id, u, sec, big, a, b, len AS used, 1 AS chunk FROM u WHERE u = 1 UNION ALL
SELECT n.doc_id, n.u, n.sec, n.big, n.a, n.b, CASE WHEN n.big <> r.big OR (n.big AND n.sec <> r.sec) OR used + n.len > 500 THEN n.len ELSE used + n.len END, CASE WHEN n.big <> r.big OR (n.big AND n.sec <> r.sec) OR used + n.len > 500 THEN chunk + 1 ELSE chunk END FROM r JOIN u n ON n.doc_id = r.doc_id AND n.u = r.u + 1),
c AS (SELECT doc_id, chunk, min(a) AS a, max(b) AS b, bool_or(big) AS big, min(sec) AS sec, count(DISTINCT sec) FILTER (sec > 0) AS sections FROM r GROUP BY doc_id, chunk)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk_no, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, CASE WHEN big THEN CAST(chunk - min(chunk) OVER (PARTITION BY doc_id, sec, big) + 1 AS BIGINT) END AS part, sections FROM c"""
)
def section_chunks(spark, sf):
    """Chunks that end where sections end; a section that does not fit is cut further."""
    rows = structure.section_chunks(table(spark, sf, "documents"), 500, is_boundary=short)
    return rows.select("doc_id", *long("chunk_no", "start_line", "end_line", "part"), F.size("sections").cast("long").alias("sections"))


@query("SELECT doc_id, CAST(chunk AS BIGINT) + 1 AS chunk_no, CAST(min(line_no) AS BIGINT) AS start_line, CAST(max(line_no) AS BIGINT) AS end_line FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS chunk FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS piece FROM (" + _LINES + "))) GROUP BY doc_id, chunk")
def document_chunks(spark, sf):
    return structure.chunks(table(spark, sf, "documents"), 500).select("doc_id", *long("chunk_no", "start_line", "end_line"))


# --- manifest, gate, indexes ------------------------------------------------------------------------------------

_STATS = f"""{_TYPED}, st AS (SELECT d.doc_id, d.lang, d.source, d.text, l.quality, count(t.doc_id) AS total_clauses, count(*) FILTER (t.clause_type = 'unmapped') AS unmapped
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY ALL),
m AS (SELECT *, CASE WHEN total_clauses > 0 THEN CAST(format('{{:.3f}}', unmapped / total_clauses) AS DOUBLE) ELSE 0 END AS ratio, nullif(lang, 'es') AS title, CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END AS confidence FROM st),
v AS (SELECT *, concat_ws('; ', CASE WHEN title IS NULL THEN 'Missing required field: title' END) AS hard,
concat_ws('; ', CASE WHEN ratio > 0.3 THEN 'ratio' END, CASE WHEN confidence = 'low' THEN 'Low classification confidence' END, CASE WHEN total_clauses < 1 THEN 'Only ' || total_clauses || ' clauses detected' END) AS soft FROM m),
g AS (SELECT *, CASE WHEN hard <> '' THEN 'quarantined' WHEN soft <> '' THEN 'staging' ELSE 'approved' END AS approval_state FROM v)"""


def _validated(spark, sf):
    # all that needs the text is worked out in its row, and no text is shuffled
    docs = library.clause_counts(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), is_boundary=short, rules=RULES, governance=None, chapter=None)
    docs = docs.withColumn("sha256", F.sha2("text", 256)).drop("text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.withColumns({"title": F.nullif(F.col("lang"), F.lit("es")), "classification_confidence": F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low"), "key": F.col("doc_id"), "doc_id": F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))})
    return library.validate(docs, required=["doc_id", "title", "sha256"], least_clauses=1)


@query(f"WITH {_STATS} SELECT doc_id, hard AS hard_fails, replace(soft, 'ratio', 'Unmapped clause ratio ' || CAST(CAST(round(ratio * 100, 1) AS DECIMAL(5,1)) AS VARCHAR) || '% exceeds 30%') AS soft_fails, hard = '' AS schema_valid FROM g")
def manifest_validate(spark, sf):
    return _validated(spark, sf).select(F.col("key").alias("doc_id"), F.array_join("hard_fails", "; ").alias("hard_fails"), F.array_join("soft_fails", "; ").alias("soft_fails"), "schema_valid")


@query(f"WITH {_STATS} SELECT doc_id, approval_state FROM g")
def approval_gate(spark, sf):
    return library.gate(_validated(spark, sf)).select(F.col("key").alias("doc_id"), "approval_state")


@query(f"WITH {_STATS} SELECT count(*) AS processed, count(*) FILTER (approval_state = 'approved') AS approved, count(*) FILTER (approval_state = 'staging') AS staged, count(*) FILTER (approval_state = 'quarantined') AS quarantined FROM g")
def run_totals(spark, sf):
    return library.run_totals(approval_gate(spark, sf))


_INDEX = f"{_STATS}, i AS (SELECT doc_id, title, source AS contract_family, lang AS language, sha256(text) AS sha256, 'approved/templates/' || source || '/doc-' || doc_id || '/' AS path FROM g WHERE approval_state = 'approved')"


def _index(spark, sf):
    rows = library.gate(_validated(spark, sf))
    lit = F.lit
    rows = rows.withColumns({"doc_class": lit("template"), "contract_family": F.col("source"), "subtype": lit(None).cast("string"), "paper_role": lit("neutral"), "jurisdiction": lit("KR"), "language": F.col("lang"), "authority_level": lit(None).cast("string"), "source_file": F.col("doc_id"), "created_at": lit("2024-01-01T00:00:00")})
    return library.index_documents(rows).withColumn("doc_id", F.substring("doc_id", 5, 20).cast("long"))


@query(f"WITH {_INDEX} SELECT doc_id, title, contract_family, language, sha256, path, '' AS subtype, 'preferred' AS authority_level, 'active' AS status FROM i")
def index_documents(spark, sf):
    return _index(spark, sf).select("doc_id", "title", "contract_family", "language", "sha256", "path", "subtype", "authority_level", "status")


@query(f"WITH {_INDEX} SELECT i.doc_id, 'clause-' || lpad(CAST(clause_no AS VARCHAR), 3, '0') AS clause_id, clause_type, header, contract_family FROM i JOIN t ON i.doc_id = t.doc_id")
def index_clauses(spark, sf):
    return library.index_clauses(_index(spark, sf), _clauses(spark, sf))


@query(f"""WITH {_INDEX}, w AS (SELECT doc_id, line_no, unnest(regexp_extract_all({_STRIP.format('line')}, '"([^"]{{2,60}})"', 1)) AS term FROM ({_LINES}))
SELECT w.doc_id, term, CAST(min(line_no) AS BIGINT) AS first_line FROM w JOIN i ON w.doc_id = i.doc_id GROUP BY ALL""")
def index_terms(spark, sf):
    terms = structure.defined_terms(table(spark, sf, "documents"), pattern='"([^"]{2,60})"')
    return library.index_terms(_index(spark, sf), terms).select("doc_id", "term", *long("first_line"))


@query(f"WITH {_INDEX} SELECT doc_id, contract_family, '' AS subtype, 'preferred' AS authority_level, path FROM i")
def retrieval_map(spark, sf):
    return library.retrieval_map(_index(spark, sf))


@query(f"WITH {_INDEX} SELECT contract_family, clause_type, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM i JOIN t ON i.doc_id = t.doc_id GROUP BY ALL")
def clause_bank(spark, sf):
    return library.clause_bank(_index(spark, sf), _clauses(spark, sf)).groupBy("contract_family", "clause_type").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
def enum_check(spark, sf):
    from docmill.sources.policy import unknown_values

    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "v string")
    return unknown_values(table(spark, sf, "orders"), "o_orderpriority", allowed, "v").select("o_orderpriority").distinct()


_CLASSES = [r[0] for r in fixed.ASSET_RULES]
_CLASS = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES[:8])) + " ELSE 'memo' END"
_SAID = lambda v: "NULL" if v is None else repr(v)
_BY_CLASS = lambda place: "CASE doc_class " + " ".join(f"WHEN '{r[0]}' THEN {_SAID(r[place])}" for r in fixed.ASSET_RULES) + " END"


@query(f"WITH {_STATS} SELECT doc_id, CASE WHEN hard <> '' THEN 'quarantined' ELSE 'staging' END AS without_auto, CASE WHEN approval_state <> 'approved' THEN approval_state WHEN coalesce({_BY_CLASS(1)}, false) THEN 'approved' ELSE 'staging' END AS by_asset FROM (SELECT *, {_CLASS} AS doc_class FROM g)")
def approval_toggle(spark, sf):
    """The gate with automatic approval off, and with rules by type of asset."""
    rows = _validated(spark, sf).withColumn("doc_class", F.expr(_CLASS.replace("doc_id", "key")))
    off = library.gate(rows, auto=False).select("key", F.col("approval_state").alias("without_auto"))
    ruled = library.gate(rows, True, library.asset_rules(spark)).select("key", F.col("approval_state").alias("by_asset"))
    return off.join(ruled, "key").select(F.col("key").alias("doc_id"), "without_auto", "by_asset")


@query(f"SELECT doc_id, doc_class, coalesce(CASE WHEN quality = 1 THEN 'own' END, {_BY_CLASS(3)}) AS authority_level, {_BY_CLASS(4)} AS external_safe FROM (SELECT *, {_CLASS} AS doc_class FROM labels)")
def enriched_assets(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.expr(_CLASS).alias("doc_class"), F.when(F.col("quality") == 1, "own").alias("authority_level"))
    return library.enrich(rows, library.asset_rules(spark)).select("doc_id", "doc_class", "authority_level", "external_safe")


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'legal' ELSE lang END AS lang, CASE WHEN toxic = 1 AND quality = 0 THEN 'elsewhere' ELSE source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def sidecar_override(spark, sf):
    side = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("legal").alias("lang"), F.when(F.col("quality") == 0, "elsewhere").alias("source"))
    return library.with_sidecar(table(spark, sf, "documents").select("doc_id", "lang", "source"), side)


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS clause_id, length(line) AS n, quality FROM ({_LINES}) LEFT JOIN labels USING (doc_id)")
def chunk_merge(spark, sf):
    """Results of chunks that overlap, as one table, and each document's shared context beside them."""
    lines = structure.lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").cast("long").alias("clause_id"), F.length("line").cast("long").alias("n"))
    parts = [lines.where(c) for c in ("clause_id <= 10", "clause_id between 8 and 40", "clause_id >= 30")]
    return review.inject_context(review.merge_chunks(*parts), table(spark, sf, "labels").select("doc_id", "quality"))


@query("SELECT doc_id, nullif(lang, 'es') AS title, sha256(text) AS sha256, doc_id % 3 = 0 AS later FROM documents")
def index_versions(spark, sf):
    """An index in two versions, the second of which replaces some rows."""
    from docmill.sources import sinks

    rows, path = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("title"), F.sha2("text", 256).alias("sha256")), scratch(spark, "index")
    sinks.index(rows.withColumn("later", F.lit(False)), path, "t1", merge_key="doc_id")
    sinks.index(rows.where("doc_id % 3 = 0").withColumn("later", F.lit(True)), path, "t2", merge_key="doc_id")
    return sinks.read_index(spark, path).select("doc_id", "title", "sha256", "later")


@query("SELECT doc_id, sha256(text) AS packed, sha256(text) AS exported, lang AS contract_family FROM documents WHERE lang IN ('en', 'de')")
def stored_packages(spark, sf):
    """Packages in buckets, JSON records and published rows by family, written and read again."""
    from docmill.sources import sinks

    base = scratch(spark, "packages")
    rows = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("contract_family"), F.when(F.col("lang").isin("en", "de"), "approved").otherwise("staging").alias("approval_state"))
    sinks.packages(rows.withColumn("run_ts", F.lit("r1")), f"{base}/packages")
    sinks.json_export(rows, f"{base}/json")
    sinks.publish(rows.select("doc_id", "contract_family", "approval_state"), f"{base}/published")
    packed = spark.read.parquet(f"{base}/packages").where(F.col("bucket") == sinks.bucket("doc_id")).select("doc_id", F.sha2("text", 256).alias("packed"))
    exported = spark.read.schema("doc_id long, text string").json(f"{base}/json").select("doc_id", F.sha2("text", 256).alias("exported"))
    return spark.read.parquet(f"{base}/published").select("doc_id", "contract_family").join(packed, "doc_id").join(exported, "doc_id").select("doc_id", "packed", "exported", "contract_family")


# --- retrieval --------------------------------------------------------------------------------------------------

_LIB = """lib AS (SELECT d.doc_id, source AS contract_family, nullif(lang, 'es') AS jurisdiction, CASE WHEN n_chars >= 2000 THEN 'long' ELSE 'short' END AS clause_type,
CASE WHEN quality = 1 THEN 'approved' ELSE 'quarantined' END AS approval_state, CASE WHEN toxic = 1 THEN 'archived' ELSE 'active' END AS status, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tgt AS (SELECT doc_id, contract_family, jurisdiction, clause_type, n_chars FROM lib WHERE status = 'archived'),
one AS (SELECT t.doc_id, t.contract_family, t.clause_type, t.n_chars, l.doc_id AS lib_doc_id, l.clause_type AS lib_clause_type, l.n_chars AS lib_n_chars, l.jurisdiction AS lib_jurisdiction FROM tgt t JOIN lib l
ON t.contract_family = l.contract_family AND (l.jurisdiction IS NULL OR t.jurisdiction IS NULL OR l.jurisdiction = t.jurisdiction) WHERE l.approval_state = 'approved' AND l.status = 'active')"""


def _library(spark, sf, *more):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.col("source").alias("contract_family"), F.nullif(F.col("lang"), F.lit("es")).alias("jurisdiction"), F.when(F.col("n_chars") >= 2000, "long").otherwise("short").alias("clause_type"),
        F.when(F.col("quality") == 1, "approved").otherwise("quarantined").alias("approval_state"), F.when(F.col("toxic") == 1, "archived").otherwise("active").alias("status"), "n_chars", *more,
    )


def _stage_one(spark, sf):
    lib = _library(spark, sf)
    targets = lib.where("status = 'archived'").drop("approval_state", "status")
    return targets, lib, retrieve.stage_one(targets, lib, optional=("jurisdiction",))


@query(f"WITH {_LIB} SELECT doc_id, lib_doc_id FROM one")
def retrieve_stage1(spark, sf):
    return _stage_one(spark, sf)[2].select("doc_id", "lib_doc_id")


@query(f"WITH {_LIB} SELECT doc_id, lib_doc_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM one) WHERE n <= 10 OR clause_type = lib_clause_type")
def retrieve_narrow(spark, sf):
    targets, lib, _ = _stage_one(spark, sf)
    return retrieve.candidates(targets, lib, "doc_id", above=10, optional=("jurisdiction",)).select("doc_id", "lib_doc_id")


@query(f"WITH {_LIB} SELECT doc_id, lib_doc_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM one) WHERE n <= 25 OR clause_type = lib_clause_type")
def retrieve_narrow_pairs(spark, sf):
    """The same of candidates that are there already."""
    return retrieve.narrow(_stage_one(spark, sf)[2], "doc_id", F.col("clause_type") == F.col("lib_clause_type"), above=25).select("doc_id", "lib_doc_id")


_CHAIN = "SELECT doc_id, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS next_id, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS supersedes FROM documents"


def _versions(spark, sf):
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.lead("doc_id").over(w).alias("next_id"), F.lag("doc_id").over(w).alias("supersedes"))


@query(f"WITH v AS ({_CHAIN}) SELECT doc_id FROM v WHERE next_id IS NULL")
def retrieve_exclude(spark, sf):
    rows = _versions(spark, sf).withColumns({"status": F.when(F.col("next_id").isNotNull(), "superseded").otherwise("active"), "approval_state": F.lit("approved")})
    # a successor need not be active itself: the newest of a chain is, and stands for the whole chain
    newest = rows.withColumn("status", F.lit("active"))
    candidates = rows.select(*(F.col(c).alias(f"lib_{c}") for c in rows.columns))
    return retrieve.exclude(candidates, newest).select(F.col("lib_doc_id").alias("doc_id"))


@query(f"WITH v AS ({_CHAIN}) SELECT a.doc_id FROM v a WHERE next_id IS NULL OR NOT EXISTS (SELECT 1 FROM v b WHERE b.supersedes = a.doc_id AND b.doc_id % 3 <> 0)")
def retrieve_exclude_inactive(spark, sf):
    """A superseded row whose successor is not active stays."""
    rows = _versions(spark, sf).withColumns({"status": F.when(F.col("next_id").isNotNull(), "superseded").otherwise("active"), "approval_state": F.lit("approved")})
    successors = rows.withColumn("status", F.when(F.col("doc_id") % 3 == 0, "deprecated").otherwise("active"))
    return retrieve.exclude(rows, successors, prefix="").select("doc_id")


GROUPS = [["src0", "src1", "src2"], ["src2", "src3"], ["src7", "src8"]]
_PAIRS = "(" + " UNION ".join(f"SELECT '{a}' AS family, '{b}' AS related" for g in GROUPS for a in g for b in g if a != b) + ")"


@query(f"SELECT family, related, n FROM {_PAIRS} JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) ON related = source WHERE family IN (SELECT source FROM documents)")
def affinity_pairs(spark, sf):
    """Related families among those that there are, with how many documents the related one has."""
    held = table(spark, sf, "documents").groupBy(F.col("source").alias("related")).agg(F.count("*").alias("n"))
    pairs = retrieve.affinity_pairs(spark, GROUPS).join(held, "related")
    return pairs.join(held.select(F.col("related").alias("family")), "family", "left_semi").select("family", "related", "n")


@query(
    f"""WITH {_LIB}, few AS (SELECT t.* FROM tgt t LEFT JOIN (SELECT doc_id, count(*) AS n FROM one GROUP BY doc_id) c ON t.doc_id = c.doc_id WHERE coalesce(n, 0) < 12)
SELECT doc_id, lib_doc_id, 0 AS penalty FROM one UNION ALL SELECT f.doc_id, l.doc_id, 1 FROM few f JOIN {_PAIRS} p ON f.contract_family = p.family JOIN lib l ON l.contract_family = p.related
AND (l.jurisdiction IS NULL OR f.jurisdiction IS NULL OR l.jurisdiction = f.jurisdiction) WHERE l.approval_state = 'approved' AND l.status = 'active'"""
)
def retrieve_affinity(spark, sf):
    targets, lib, one = _stage_one(spark, sf)
    return retrieve.widen(one, targets, lib, retrieve.affinity_pairs(spark, GROUPS), "doc_id", below=12, optional=("jurisdiction",)).select("doc_id", "lib_doc_id", F.col("penalty").cast("int").alias("penalty"))


@query(
    f"""WITH {_LIB}, few AS (SELECT t.* FROM tgt t LEFT JOIN (SELECT doc_id, count(*) AS n FROM one WHERE lib_doc_id % 2 = 0 GROUP BY doc_id) c ON t.doc_id = c.doc_id WHERE coalesce(n, 0) < 12)
SELECT doc_id, lib_doc_id, 0 AS penalty FROM one WHERE lib_doc_id % 2 = 0 UNION ALL SELECT f.doc_id, l.doc_id, 1 FROM few f JOIN {_PAIRS} p ON f.contract_family = p.family JOIN lib l ON l.contract_family = p.related
AND (l.jurisdiction IS NULL OR f.jurisdiction IS NULL OR l.jurisdiction = f.jurisdiction) WHERE l.approval_state = 'approved' AND l.status = 'active' AND l.doc_id % 2 = 0"""
)
def retrieve_external(spark, sf):
    """What may not be shown outside leaves the library first, so that related families do not bring it back."""
    lib = _library(spark, sf)
    targets = lib.where("status = 'archived'").drop("approval_state", "status")
    safe = retrieve.external_only(lib.withColumn("external_safe", F.col("doc_id") % 2 == 0), True, "external_safe").drop("external_safe")
    one = retrieve.stage_one(targets, safe, optional=("jurisdiction",))
    return retrieve.widen(one, targets, safe, retrieve.affinity_pairs(spark, GROUPS), "doc_id", below=12, optional=("jurisdiction",)).select("doc_id", "lib_doc_id", F.col("penalty").cast("int").alias("penalty"))


@query(f"WITH {_LIB} SELECT doc_id, lib_doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN clause_type = lib_clause_type THEN 0 ELSE 1 END, abs(n_chars - lib_n_chars), lib_doc_id) AS n FROM one) WHERE n = 1")
def retrieve_rank_top1(spark, sf):
    order = [F.when(F.col("clause_type") == F.col("lib_clause_type"), 0).otherwise(1), F.abs(F.col("n_chars") - F.col("lib_n_chars")), F.col("lib_doc_id")]
    targets, lib, _ = _stage_one(spark, sf)
    return retrieve.best(retrieve.nearest(targets, lib, "doc_id", "n_chars", optional=("jurisdiction",)), "doc_id", order).select("doc_id", "lib_doc_id")


@query(f"WITH {_LIB} SELECT count(*) AS n, count(o.doc_id) AS matched, round(count(o.doc_id) / count(*), 6) AS rate, count(o.doc_id) / count(*) >= 0.5 AS reached FROM tgt LEFT JOIN (SELECT DISTINCT doc_id FROM one) o ON tgt.doc_id = o.doc_id")
def match_rate(spark, sf):
    targets, _, one = _stage_one(spark, sf)
    return retrieve.match_rate(targets, one, "doc_id").select("n", "matched", F.round("rate", 6).alias("rate"), "reached")


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') > 365 AS stale, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') > 365 THEN 1 ELSE 0 END AS penalty FROM orders")
def freshness_flag(spark, sf):
    return retrieve.freshness(table(spark, sf, "orders"), "o_orderdate", F.lit("1998-06-01").cast("date")).select("o_orderkey", "stale", "penalty")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') > 30")
def staging_retention(spark, sf):
    rows = table(spark, sf, "orders").withColumn("approval_state", F.when(F.col("o_orderstatus") == "P", "staging").otherwise("approved"))
    return lifecycle.overdue(rows, "o_orderdate", F.lit("1998-06-01").cast("date")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 ELSE 6 END AS rank FROM lineitem")
def priority_rank(spark, sf):
    authority = F.when(F.col("l_returnflag") == "A", "preferred").when(F.col("l_returnflag") == "N", "acceptable").when(F.col("l_returnflag") == "R", "fallback")
    kind = F.when(F.col("l_returnflag") == "R", "precedent").otherwise("template")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", retrieve.rank_of(retrieve.priority(kind, authority, F.lit("approved"))).alias("rank"))


_RANKS = dict(fixed.PRIORITY)


@query(
    f"""WITH lib AS (SELECT doc_id, source AS contract_family, lang AS subtype, CASE doc_id % 3 WHEN 0 THEN {_RANKS['preferred_template']} WHEN 1 THEN {_RANKS['acceptable_template']} ELSE {_RANKS['fallback_template']} END AS rank FROM documents WHERE doc_id % 5 <> 0 AND n_chars >= 300),
q AS (SELECT p_partkey AS request_id, 'src' || p_partkey % 7 AS contract_family, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS subtype FROM part)
SELECT q.request_id, first(lib.doc_id ORDER BY coalesce(q.subtype = lib.subtype, false) DESC, rank, lib.doc_id) AS template_id FROM q LEFT JOIN lib ON q.contract_family = lib.contract_family GROUP BY q.request_id"""
)
def template_lookup(spark, sf):
    n = F.col("doc_id")
    level = F.when(n % 3 == 0, "preferred").when(n % 3 == 1, "acceptable").otherwise("fallback")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("contract_family"), F.col("lang").alias("subtype"), F.when(n % 5 == 0, "playbook").otherwise("template").alias("doc_class"), level.alias("authority_level"), F.lit("approved").alias("approval_state"), F.when(F.col("n_chars") >= 300, "active").otherwise("deprecated").alias("status"))
    k = F.col("p_partkey")
    requests = table(spark, sf, "part").select(k.alias("request_id"), F.concat(F.lit("src"), (k % 7).cast("string")).alias("contract_family"), F.when(k % 3 == 0, "en").when(k % 3 == 1, "fr").alias("subtype"))
    return retrieve.template_for(requests, docs).select("request_id", "template_id")


# --- review -----------------------------------------------------------------------------------------------------

_RISK = "CASE WHEN quality = 0 AND toxic = 1 THEN 'critical' WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' WHEN doc_id % 3 = 0 THEN 'low' ELSE 'acceptable' END"


def _risks(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    risk = F.when((q == 0) & (t == 1), "critical").when(t == 1, "high").when(q == 0, "medium").when(F.col("doc_id") % 3 == 0, "low").otherwise("acceptable")
    return table(spark, sf, "labels").withColumn("risk_level", risk)


def _scoped(mode: str):
    values = fixed.MODES[mode]
    quoted = lambda x: ", ".join(f"'{v}'" for v in x)

    def run(spark, sf):
        rows = review.with_mode(_risks(spark, sf).withColumn("mode", F.lit(mode)), review.modes(spark))
        return review.redline_scope(rows).select("doc_id", "risk_level", F.array_contains("comment_scope", F.col("risk_level")).alias("comment"))

    query(f"SELECT doc_id, risk_level, risk_level IN ({quoted(values['comments'])}) AS comment FROM (SELECT doc_id, {_RISK} AS risk_level FROM labels) WHERE risk_level IN ({quoted(values['redline'])})", f"review_scope_{mode}")(run)


for _mode in fixed.MODES:
    _scoped(_mode)


@query("SELECT doc_id, m.mode, tier IN ('preferred') OR (m.mode <> 'strict' AND tier = 'acceptable') OR (m.mode = 'loose' AND tier = 'fallback') AS acceptable FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'preferred' WHEN quality = 1 THEN 'acceptable' ELSE 'fallback' END AS tier FROM labels), (VALUES ('strict'), ('moderate'), ('loose')) m(mode)")
def tier_acceptance(spark, sf):
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "preferred").when(F.col("quality") == 1, "acceptable").otherwise("fallback")
    rows = table(spark, sf, "labels").select("doc_id", tier.alias("playbook_tier"), F.explode(F.array(*map(F.lit, fixed.MODES))).alias("mode"))
    return review.tier_acceptance(review.with_mode(rows, review.modes(spark))).select("doc_id", "mode", "acceptable")


@query("SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'strict' END, CASE WHEN fam IN ('nda', 'mou') THEN 'loose' WHEN fam = 'spa' THEN 'strict' END, 'moderate') AS mode FROM (SELECT doc_id, toxic, CASE doc_id % 4 WHEN 0 THEN 'nda' WHEN 1 THEN 'spa' WHEN 2 THEN 'mou' ELSE 'zzz' END AS fam FROM labels)")
def mode_resolve(spark, sf):
    m = F.col("doc_id") % 4
    rows = table(spark, sf, "labels").withColumns({"contract_family": F.when(m == 0, "nda").when(m == 1, "spa").when(m == 2, "mou").otherwise("zzz"), "override": F.when(F.col("toxic") == 1, "strict")})
    return review.resolve_mode(rows, review.modes(spark), "override").select("doc_id", "mode")


@query("SELECT event_id, CASE WHEN contains(event_type, 'click') THEN 'strict' WHEN contains(event_type, 'view') THEN 'loose' END AS mode FROM events")
def mode_words(spark, sf):
    said = F.when(F.col("event_type") == "click", "please be strict, not loose").when(F.col("event_type") == "view", "a QUICK look").otherwise("as ever")
    return table(spark, sf, "events").select("event_id", review.mode_of_text(said).alias("mode"))


_ALIASES = [("nda", "Non-Disclosure", ["ECONOMY", "cda"]), ("spa", "Share Purchase", ["PROMO"]), ("sow", "Statement of Work", [])]


@query("SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'nda' WHEN 'promo' THEN 'spa' END AS contract_family FROM part")
def alias_resolve(spark, sf):
    families = spark.createDataFrame([(*f, []) for f in _ALIASES], "id string, name string, aliases array<string>, subtypes array<string>")
    return library.resolve_alias(table(spark, sf, "part"), families, "p_type").select("p_partkey", "contract_family")


@query("SELECT d.doc_id, l.doc_id IS NULL AS playbook_missing, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def playbook_missing(spark, sf):
    return review.with_playbook(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality"), ("doc_id",)).select("doc_id", "playbook_missing", "quality")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, length(text), turn) AS n FROM conversations) WHERE n = 1")
def comment_pick(spark, sf):
    rows = table(spark, sf, "conversations")
    order = [F.when(F.col("role") == "assistant", 0).otherwise(1), F.length("text"), F.col("turn")]
    return review.pick_comment(rows.select("conv_id").distinct(), rows, ["conv_id"], order, ["conv_id"]).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, text FROM conversations WHERE role <> 'system'")
def firewall_external(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("said", F.when(F.col("role") == "system", F.concat(F.lit("[INTERNAL] "), "text")).otherwise(F.col("text")))
    return review.external(rows, "said").select("conv_id", "turn", "text")


@query(f"SELECT doc_id FROM (SELECT doc_id, quality, {_RISK} AS r FROM labels) WHERE r IN ('critical', 'high') AND quality = 0")
def mandatory_fields(spark, sf):
    rows = _risks(spark, sf).withColumns({"external_comment": F.when(F.col("quality") == 1, "yes"), "suggested_redline": F.lit("text")})
    return review.mandatory_missing(rows).select("doc_id")


@query(f"SELECT {', '.join(f'''count(*) FILTER (r = '{r}') AS n_{r}''' for r in fixed.RISKS)} FROM (SELECT {_RISK} AS r FROM labels)")
def risk_profile(spark, sf):
    return review.risk_profile(_risks(spark, sf))


@query(f"SELECT doc_id, r AS risk_level FROM (SELECT doc_id, {_RISK} AS r FROM labels) ORDER BY CASE r WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, doc_id LIMIT 5")
def top_issues(spark, sf):
    return review.top_issues(_risks(spark, sf), "doc_id").select("doc_id", "risk_level")


_NORM = "lower(regexp_replace(trim({}), '\\s+', ' ', 'g'))"
_MAP = f"SELECT d.doc_id, min(b.item_id) AS paragraph_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) b ON {_NORM.format('d.line')} = {_NORM.format('b.line')} GROUP BY d.doc_id"


def _mapped(spark, sf):
    rows = structure.lines(table(spark, sf, "documents")).withColumnRenamed("line", "body")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("paragraph_id"), F.explode(structure.lines_of(F.col("text"))).alias("text"))
    return review.paragraph_map(rows, items)


@query(_MAP)
def paragraph_map(spark, sf):
    return _mapped(spark, sf).where("paragraph_id is not null").groupBy("doc_id").agg(F.min("paragraph_id").alias("paragraph_id"))


@query(f"SELECT count(*) AS n, count(m.paragraph_id) AS mapped, round(count(m.paragraph_id) / count(*), 6) AS coverage, count(m.paragraph_id) / count(*) >= 0.9 AS reached FROM documents d LEFT JOIN ({_MAP}) m ON d.doc_id = m.doc_id")
def mapping_coverage(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(paragraph_map(spark, sf), "doc_id", "left")
    return review.mapping_coverage(rows).select("n", "mapped", F.round("coverage", 6).alias("coverage"), "reached")


_HOLDS = f"SELECT d.doc_id, min(b.item_id) AS paragraph_id FROM documents d JOIN benchmark b ON {_NORM.format('b.text')} <> '' AND contains({_NORM.format('d.text')}, {_NORM.format('b.text')}) GROUP BY d.doc_id"


@query(_HOLDS)
def paragraph_contains(spark, sf):
    """Whole items inside documents, which ``paragraph_map``, of whole lines, does not see."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("paragraph_id"), "text")
    return review.paragraph_contains(docs, items, "doc_id", body="text").groupBy("doc_id").agg(F.min("paragraph_id").alias("paragraph_id"))


@query()
def paragraph_fuzzy(spark, sf):
    """Whole items inside documents with up to a tenth of their words changed; tests compare it with all distances."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("paragraph_id"), "text")
    return review.paragraph_fuzzy(docs, items, "doc_id", body="text")


@query(f"SELECT count(*) AS n, count(m.paragraph_id) AS mapped, round(count(m.paragraph_id) / count(*), 6) AS coverage, count(m.paragraph_id) / count(*) >= 0.9 AS reached FROM documents d LEFT JOIN ({_HOLDS}) m ON d.doc_id = m.doc_id")
def contains_coverage(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(paragraph_contains(spark, sf), "doc_id", "left")
    return review.mapping_coverage(rows).select("n", "mapped", F.round("coverage", 6).alias("coverage"), "reached")


_TURNS = "(SELECT a.conv_id, a.turn, a.role, a.text AS prior, b.text AS current FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w <> ''))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({_WORDS(a)}, {_WORDS(b)})))"
    return f"CASE WHEN {both} > 0 THEN len(list_intersect({_WORDS(a)}, {_WORDS(b)})) / {both} ELSE 0.0 END"


def _turns(spark, sf):
    rows = table(spark, sf, "conversations")
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("current"))
    return rows.select("conv_id", "turn", "role", F.col("text").alias("prior")).join(later, ["conv_id", "turn"], "left")


@query(
    f"""SELECT conv_id, turn, round(s, 6) AS similarity, CASE WHEN s >= 0.9 THEN 'acceptable' WHEN s >= 0.7 THEN 'low' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.25 THEN 'high' ELSE 'critical' END AS risk_level,
CASE WHEN s >= 0.7 THEN 'preferred' WHEN s >= 0.5 THEN 'acceptable' WHEN s >= 0.25 THEN 'fallback' END AS playbook_tier, s < 0.7 AS commented FROM (SELECT *, {_jaccard('prior', "coalesce(current, '')")} AS s FROM {_TURNS})"""
)
def analysed_pairs(spark, sf):
    """Each turn against the next as its house wording: similarity, risk, tier, and whether it gets a comment."""
    rows = review.comment_texts(review.analyse(_turns(spark, sf).withColumn("clause_type", F.col("role")).withColumn("lib_text", F.col("current")), "prior", "current"))
    return rows.select("conv_id", "turn", F.round("similarity", 6).alias("similarity"), "risk_level", "playbook_tier", F.col("external_comment").isNotNull().alias("commented"))


_LISTED = lambda values: ", ".join(f"'{v}'" for v in values)
_MODERATE = fixed.MODES[fixed.DEFAULT_MODE]
_AUTHORITY = f"CASE lib_id % 3 WHEN 0 THEN {_RANKS['preferred_template']} WHEN 1 THEN {_RANKS['acceptable_template']} ELSE {_RANKS['fallback_template']} END"


@query(
    f"""WITH {_LIB}, w AS (SELECT d.doc_id, text AS said FROM documents d),
p AS (SELECT o.doc_id, o.lib_doc_id AS lib_id, o.clause_type = o.lib_clause_type AS same, count(*) OVER (PARTITION BY o.doc_id) AS n FROM one o),
s AS (SELECT p.*, {_AUTHORITY} AS rank, {_jaccard('a.said', 'b.said')} AS s FROM p JOIN w a ON p.doc_id = a.doc_id JOIN w b ON p.lib_id = b.doc_id WHERE n <= {fixed.NARROW_ABOVE} OR same),
f AS (SELECT tgt.doc_id, lib_id, coalesce(s, 0.0) AS s FROM tgt LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, same DESC, s DESC, lib_id) AS place FROM s) x ON tgt.doc_id = x.doc_id AND place = 1),
r AS (SELECT *, CASE WHEN s >= 0.9 THEN 'acceptable' WHEN s >= 0.7 THEN 'low' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.25 THEN 'high' ELSE 'critical' END AS risk_level, CASE WHEN s >= 0.7 THEN 'preferred' WHEN s >= 0.5 THEN 'acceptable' WHEN s >= 0.25 THEN 'fallback' END AS tier FROM f)
SELECT doc_id AS clause_id, lib_id AS lib_doc_id, round(s, 6) AS similarity, risk_level, coalesce(tier IN ({_LISTED(_MODERATE['tiers'])}), false) AS acceptable, risk_level IN ({_LISTED(_MODERATE['redline'])}) AS redline, risk_level IN ({_LISTED(_MODERATE['comments'])}) AS comment FROM r"""
)
def contract_review(spark, sf):
    """The whole review: candidates, the best house clause of each target by whole texts, risk, tier and the scopes of the mode."""
    from docmill.plans.library import Review

    # read several times, and joined once
    lib = saved(_library(spark, sf, "text"), "library")
    target = lib.where("status = 'archived'").select(F.col("doc_id").alias("clause_id"), "clause_type", "contract_family", "jurisdiction", F.lit(None).cast("string").alias("governing_law"), "text")
    n = F.col("doc_id") % 3
    level = F.when(n == 0, "preferred").when(n == 1, "acceptable").otherwise("fallback")
    bank = lib.withColumns({"clause_id": F.lit("clause-001"), "doc_class": F.lit("template"), "authority_level": level, "supersedes": F.lit(None).cast("long")})
    return Review.run(target, bank, bank).select("clause_id", "lib_doc_id", F.round("similarity", 6).alias("similarity"), "risk_level", "acceptable", "redline", "comment")


@query(f"SELECT conv_id, turn, CASE WHEN length(current) / greatest(1, length(prior)) < 0.8 THEN 'narrowing' WHEN length(current) / greatest(1, length(prior)) > 1.25 THEN 'broadening' WHEN {_jaccard('prior', 'current')} >= 0.5 THEN 'clarification' ELSE 'rewrite' END AS kind FROM {_TURNS} WHERE current IS NOT NULL")
def change_kinds(spark, sf):
    rows = _turns(spark, sf).where("current is not null")
    return rows.select("conv_id", "turn", rounds.change_kind(F.col("prior"), F.col("current")).alias("kind"))


@query(
    f"""WITH o AS (SELECT conv_id, turn, text AS prior, CASE WHEN turn % 5 <> 0 THEN text || ' we propose' END AS proposed, CASE turn % 5 WHEN 1 THEN text || ' we propose' WHEN 2 THEN text WHEN 3 THEN text || ' they propose' END AS current FROM conversations)
SELECT conv_id, turn, CASE WHEN proposed IS NULL THEN NULL WHEN current = proposed THEN 'accepted' WHEN current IS NULL OR current = prior OR {_jaccard('current', 'proposed')} < 0.5 THEN 'rejected' ELSE 'partial' END AS answer FROM o"""
)
def negotiation_answers(spark, sf):
    """What became of each of our proposals."""
    t, text_ = F.col("turn") % 5, F.col("text")
    proposed = F.when(t != 0, F.concat(text_, F.lit(" we propose")))
    current = F.when(t == 1, F.concat(text_, F.lit(" we propose"))).when(t == 2, text_).when(t == 3, F.concat(text_, F.lit(" they propose")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text_.alias("prior"), proposed.alias("proposed"), current.alias("current"))
    return rows.select("conv_id", "turn", rounds.answer(F.col("prior"), F.col("proposed"), F.col("current")).alias("answer"))


@query("SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN text END, '[MANUAL_REQUIRED] comment') AS said FROM conversations")
def manual_fallback(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", review.or_manual(F.when(F.col("role") == "user", F.col("text"))).alias("said"))


_SEVERE = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(fixed.RISKS))
_COUNTED = " || ".join(f"chr(10) || '{r}: ' || count(*) FILTER (sev = {i})" for i, r in enumerate(fixed.RISKS))


@query(
    f"""WITH c AS (SELECT doc_id, 'line-' || lpad(CAST(line_no AS VARCHAR), 6, '0') AS clause_id, length(line) % 5 AS sev FROM ({_LINES})),
t AS (SELECT doc_id, string_agg(clause_id || ': ' || CASE sev {_SEVERE} END, chr(10) ORDER BY place) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sev, clause_id) AS place FROM c) WHERE place <= 5 GROUP BY doc_id),
n AS (SELECT doc_id, 'Review report' || chr(10) || 'Summary' || chr(10) || 'Clauses: ' || count(*) || {_COUNTED} || chr(10) || 'Redlines: ' || count(*) FILTER (sev < 2) || ', comments: ' || count(*) FILTER (sev < 3) || chr(10) || 'Key issues' AS head FROM c GROUP BY doc_id)
SELECT doc_id, sha256(head || chr(10) || issues) AS report FROM n JOIN t USING (doc_id)"""
)
def report_docx(spark, sf):
    """The report of each document as a DOCX file, read again."""
    sev = F.length("line") % 5
    risk = F.element_at(F.array(*map(F.lit, fixed.RISKS)), sev + 1)
    rows = structure.lines(table(spark, sf, "documents")).select("doc_id", F.format_string("line-%06d", "line_no").alias("clause_id"), risk.alias("risk_level"), (sev < 2).alias("redline"), (sev < 3).alias("comment"))
    files = docx.report_files(review.report(rows)).select("doc_id", "content")
    return docx.extract(files).select("doc_id", F.sha2("plain", 256).alias("report"))


@query("SELECT turn, conv_id, CASE WHEN role = 'user' THEN 'preferred' WHEN role = 'system' THEN 'fallback' ELSE 'acceptable' END AS tier, coalesce(CASE WHEN turn > 3 THEN 'en' END, CASE WHEN role = 'user' THEN 'ko-en' END, 'ko') AS language FROM conversations")
def draft_settings(spark, sf):
    leverage = F.when(F.col("role") == "user", "strong").when(F.col("role") == "system", "weak").otherwise("other")
    language = review.output_language(F.when(F.col("turn") > 3, "en"), F.when(F.col("role") == "user", "ko-en"))
    return table(spark, sf, "conversations").select("turn", "conv_id", review.draft_tier(leverage).alias("tier"), language.alias("language"))


# --- rounds and lifecycle ---------------------------------------------------------------------------------------

_DIFF = """SELECT coalesce(p.conv_id, c.conv_id) AS conv_id, coalesce(p.n, c.n) AS ordinal, CASE WHEN p.conv_id IS NULL THEN 'added' WHEN c.conv_id IS NULL THEN 'removed' WHEN p.role = c.role THEN 'unchanged' ELSE 'modified' END AS diff_status
FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn < 3) p FULL JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn >= 2) c ON p.conv_id = c.conv_id AND p.n = c.n"""


def _diff(spark, sf):
    rows = table(spark, sf, "conversations")
    one, two = (rounds.with_ordinal(rows.where(c), ["conv_id"], "turn") for c in ("turn < 3", "turn >= 2"))
    return rounds.diff(one, two, ["conv_id", "ordinal"], "role")


@query(_DIFF)
def round_diff(spark, sf):
    return _diff(spark, sf).select("conv_id", *long("ordinal"), "diff_status")


@query(f"SELECT CASE diff_status WHEN 'added' THEN 'new' WHEN 'removed' THEN 'resolved' WHEN 'modified' THEN 'changed' ELSE 'open' END AS bucket, count(*) AS n FROM ({_DIFF}) GROUP BY ALL")
def delta_report(spark, sf):
    return rounds.delta_report(_diff(spark, sf))


#: Every line of every text behind its number, and what the next round makes of it: some go, some change, others come.
_NUMBERED = "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x), chr(10)) AS text FROM documents)"
_DRAFT = f"(SELECT doc_id, line_no, line_no || '. ' || line AS old, CASE WHEN line_no % 11 = 4 THEN line_no || '. ' || line || ' amended' ELSE line_no || '. ' || line END AS new, line_no % 7 = 3 AS gone FROM ({_LINES}))"


def _numbered(spark, sf):
    said = F.transform(structure.lines_of(F.col("text")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(said, "\n").alias("text"))


def _drafts(spark, sf):
    lines = structure.lines(_numbered(spark, sf)).select("doc_id", F.col("line_no").alias("n"), F.col("line").alias("text"))
    prior = lines.select("doc_id", (F.col("n") * 2).alias("ordinal"), "text")
    kept = lines.where("n % 7 <> 3").select("doc_id", (F.col("n") * 2).alias("ordinal"), F.when(F.col("n") % 11 == 4, F.concat("text", F.lit(" amended"))).otherwise(F.col("text")).alias("text"))
    added = lines.where("n % 5 = 0").select("doc_id", (F.col("n") * 2 + 1).alias("ordinal"), F.concat(F.lit("zqx zqy zqz "), F.col("n").cast("string")).alias("text"))
    return prior, kept.union(added)


@query(
    f"""SELECT doc_id, CAST(line_no * 2 AS BIGINT) AS prior_no, CASE WHEN NOT gone THEN CAST(line_no * 2 AS BIGINT) END AS current_no, CASE WHEN gone THEN 'removed' WHEN old = new THEN 'unchanged' ELSE 'modified' END AS diff_status, CASE WHEN NOT gone THEN length(new) END AS n_chars FROM {_DRAFT}
UNION ALL SELECT doc_id, NULL, CAST(line_no * 2 + 1 AS BIGINT), 'added', length('zqx zqy zqz ' || line_no) FROM {_DRAFT} WHERE line_no % 5 = 0"""
)
def round_align(spark, sf):
    """Lines as clauses: what comes or goes shifts nothing."""
    rows = rounds.align(*_drafts(spark, sf), "doc_id")
    return rows.select("doc_id", "prior_no", "current_no", "diff_status", F.length("current_text").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, length(line) - length(replace(line, ' the ', ' ')) AS deleted, 9 AS inserted, true AS restores FROM ({_LINES})")
def clause_diff(spark, sf):
    """A script from each line to one with some words off and others on, which gives both back."""
    new = F.concat(F.replace("line", F.lit(" the "), F.lit(" ")), F.lit("§amended§"))
    rows = rounds.word_diff(structure.lines(table(spark, sf, "documents")).withColumn("new", new), "line", "new", most=4000)
    chars = lambda op: F.aggregate(F.filter("script", lambda s: s["op"] == op), F.lit(0), lambda n, s: n + F.length(s["text"])).cast("long")
    restores = (rounds.before(F.col("script")) == F.col("line")) & (rounds.after(F.col("script")) == F.col("new"))
    return rows.select("doc_id", *long("line_no"), chars("delete").alias("deleted"), chars("insert").alias("inserted"), restores.alias("restores"))


_AMENDED = "CASE WHEN line_no % 5 = 2 THEN replace(line, ' the ', ' any ') || '§' ELSE line END"


def _redlined(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    place, n = F.col("line_no") - 1, F.col("line_no")
    edits = structure.lines(docs).where("line_no % 5 = 2 or line_no % 7 = 0").select(
        "doc_id", F.format_string("line-%06d", "line_no").alias("clause_id"), place.alias("first"), place.alias("last"), F.when(n % 5 == 2, F.concat(F.replace("line", F.lit(" the "), F.lit(" any ")), F.lit("§"))).alias("new_text"),
        F.when(n % 7 == 0, F.lit("Please explain.")).alias("external_comment"), F.when(n % 10 == 2, F.lit("our fallback")).alias("internal_note"),
    )
    return redline.apply(docx.written(docs).select("doc_id", "content"), edits)


@query(
    f"""SELECT doc_id, sha256(string_agg({_AMENDED}, chr(10) ORDER BY line_no)) AS accepted, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS rejected, count(*) FILTER (line_no % 7 = 0) + count(*) FILTER (line_no % 10 = 2) AS comments,
count(*) FILTER (line_no % 7 = 0) AS external_comments, count(*) FILTER (line_no % 5 = 2 OR line_no % 7 = 0) AS applied, 0 AS skipped FROM ({_LINES}) GROUP BY doc_id"""
)
def docx_redline(spark, sf):
    """Every text as a DOCX file, with tracked changes and comments: both readings of the file, and of the copy for others."""
    rows = _redlined(spark, sf)
    # both copies are read in the row that holds them, so files are marked once
    ours = redline.readings(rows.select("doc_id", F.size("applied").alias("applied"), F.size("skipped").alias("skipped"), "clean", F.col("redlined").alias("content")))
    ours = ours.select("doc_id", "applied", "skipped", F.sha2("accepted", 256).alias("ours"), F.sha2("rejected", 256).alias("theirs"), F.size("comments").cast("long").alias("n"), F.col("clean").alias("content"))
    both = redline.readings(ours).withColumns({"external_comments": F.size("comments"), "clean": F.sha2("accepted", 256)}).where(F.col("ours") == F.col("clean"))
    return both.select("doc_id", F.col("ours").alias("accepted"), F.col("theirs").alias("rejected"), F.col("n").alias("comments"), *long("external_comments", "applied", "skipped"))


@query(f"SELECT doc_id, text AS plain, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), chr(10)) AS md FROM documents")
def docx_text(spark, sf):
    """Every text as a DOCX file, read again in both forms."""
    return docx.extract(docx.written(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "content")).where("error is null").select("doc_id", "plain", "md")


_DRAFTED = "text || CASE doc_id % 6 WHEN 0 THEN ' [Insert name]' WHEN 1 THEN ' TBD' WHEN 2 THEN ' $___' WHEN 3 THEN ' [ ]' WHEN 4 THEN ' TBDX [12]' ELSE '' END"


@query(f"SELECT doc_id, regexp_matches({_DRAFTED}, '\\bTBD\\b|\\$_{{2,}}|_{{4,}}|\\[\\s*\\]|\\[(?i:insert|name|date|amount|●)[^\\]]*\\]') AS open FROM documents")
def open_places(spark, sf):
    """Drafts that still have places to be filled in."""
    return table(spark, sf, "documents").select("doc_id", text.placeholder(F.expr(_DRAFTED)).alias("open"))


@query(f"WITH {_cut(_NUMBERED, 'length(header) < 40')} SELECT doc_id, 'clause-' || lpad(CAST(clause_no AS VARCHAR), 3, '0') AS clause_id, CAST(start_line - 1 AS BIGINT) AS first, CAST(end_line - 1 AS BIGINT) AS last FROM s")
def docx_clause_map(spark, sf):
    """Each clause's paragraphs in the DOCX file of its document."""
    docs = _numbered(spark, sf)
    clauses = structure.clauses(docs, is_boundary=short, rules=[], governance=None, chapter=None)
    return redline.clause_map(clauses, redline.paragraph_places(docx.written(docs))).select("doc_id", "clause_id", *long("first", "last"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_role FROM conversations")
def prior_risk(spark, sf):
    return rounds.prior_value(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "role", "prior_role")


@query("SELECT c.conv_id, c.turn, p.text AS prior_text FROM conversations c LEFT JOIN (SELECT conv_id, turn + 1 AS turn, text FROM conversations) p ON c.conv_id = p.conv_id AND c.turn = p.turn")
def carry_forward(spark, sf):
    rows = table(spark, sf, "conversations")
    return rounds.carry_forward(rows, rows.withColumn("turn", F.col("turn") + 1), ["conv_id", "turn"], ["text"]).select("conv_id", "turn", "prior_text")


@query("SELECT conv_id, max(turn) AS latest, max(turn) + 1 AS next FROM conversations GROUP BY conv_id")
def latest_round(spark, sf):
    return rounds.latest_round(table(spark, sf, "conversations"), "conv_id", "turn")


#: Every line as a section that refers to one or three others of its text, by the line's own length.
_SECTIONED = f"(SELECT doc_id, CAST(line_no AS BIGINT) AS k, line, length(line) % total + 1 AS a, CASE WHEN line_no % 4 = 0 THEN length(line) % total + 3 ELSE length(line) % total + 1 END AS b, total FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM ({_LINES})))"
_EDGES = f"SELECT doc_id, k, CASE WHEN a = b THEN 'Section ' || a ELSE 'Sections ' || a || ' to ' || b END AS ref, t, t <= total AS resolved FROM (SELECT *, unnest(CASE WHEN b <= total THEN range(a, b + 1) ELSE list_append(range(a, total + 1), b) END) AS t FROM {_SECTIONED})"


def _sectioned(spark, sf):
    lines = structure.lines_of(F.col("text"))
    a = lambda x: F.length(x) % F.size("_l") + 1
    ref = lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("Sections "), a(x).cast("string"), F.lit(" to "), (a(x) + 2).cast("string"))).otherwise(F.concat(F.lit("Section "), a(x).cast("string")))
    said = F.transform("_l", lambda x, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(". "), x, F.lit(" (see "), ref(x, i), F.lit(")")))
    return table(spark, sf, "documents").withColumn("_l", lines).select("doc_id", F.array_join(said, "\n").alias("text"))


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT doc_id, k, t FROM e WHERE resolved UNION SELECT r.doc_id, r.k, e.t FROM r JOIN e ON r.doc_id = e.doc_id AND r.t = e.k WHERE e.resolved)
SELECT e.doc_id, e.k AS from_line, CAST(e.k AS VARCHAR) AS from_label, e.ref, CAST(e.t AS VARCHAR) AS to_label, CASE WHEN e.resolved THEN CAST(e.t AS BIGINT) END AS to_line, e.resolved, e.resolved AND (e.t = e.k OR r.k IS NOT NULL) AS cyclic FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.t = r.k AND e.k = r.t"""
)
def reference_graph(spark, sf):
    """References resolved by the labels of their own document, ranges and those that point nowhere or in circles."""
    return structure.reference_graph(_sectioned(spark, sf)).select("doc_id", *long("from_line"), "from_label", "ref", "to_label", *long("to_line"), "resolved", "cyclic")


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT doc_id, k FROM {_SECTIONED} WHERE length(line) % 13 = 0 UNION SELECT e.doc_id, e.k FROM r JOIN e ON r.doc_id = e.doc_id AND r.k = e.t WHERE e.resolved) SELECT doc_id, k AS clause FROM r")
def affected_clauses(spark, sf):
    """What a change of some sections reaches, over any number of references."""
    graph = structure.reference_graph(_sectioned(spark, sf)).where("resolved")
    edges = graph.select("doc_id", F.col("from_label").alias("from_id"), F.col("to_label").alias("to_id"))
    changed = structure.lines(table(spark, sf, "documents")).where(F.length("line") % 13 == 0).select("doc_id", F.col("line_no").cast("string").alias("clause_id"))
    return rounds.affected(changed, edges).select("doc_id", F.col("clause_id").cast("long").alias("clause"))


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS last_step, max(ts) AS at FROM events GROUP BY user_id")
def resume_point(spark, sf):
    return rounds.resume_point(table(spark, sf, "events"), "user_id", "event_type", "ts")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def partial_rerun(spark, sf):
    rows = table(spark, sf, "conversations")
    return rounds.only_affected(rows, rows.where("role = 'system'"), ["conv_id"]).select("conv_id", "turn")


@query("SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS latest_id, count(*) OVER (PARTITION BY text) - row_number() OVER (PARTITION BY text ORDER BY doc_id) AS depth, false AS cycle FROM documents QUALIFY doc_id < max(doc_id) OVER (PARTITION BY text)")
def supersession_chain(spark, sf):
    return lifecycle.chains(_versions(spark, sf).where("next_id is not null").select("doc_id", "next_id"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'quarantined' WHEN quality = 0 THEN 'archived' ELSE 'approved' END AS approval_state, CASE WHEN toxic = 0 AND quality = 0 THEN 'archived' ELSE 'active' END AS status FROM labels")
def decisions(spark, sf):
    rows = table(spark, sf, "labels")
    chosen = rows.select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "archive").otherwise("approve").alias("decision"))
    staged = rows.select("doc_id", F.lit("staging").alias("approval_state"), F.lit("active").alias("status"), F.lit("preferred").alias("authority_level"))
    return lifecycle.decide(staged, chosen).select("doc_id", "approval_state", "status")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'archived' WHEN quality = 0 THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN quality = 1 THEN '2024-05-01' ELSE '2020-01-01' END AS refreshed FROM labels")
def library_commands(spark, sf):
    from docmill.plans.library import Library

    labels = table(spark, sf, "labels")
    rows = labels.select("doc_id", F.lit("active").alias("status"), F.lit("2020-01-01").alias("last_legal_refresh_date"))
    rows = Library.deprecate(rows, labels.where("quality = 0"))
    rows = Library.archive(rows, labels.where("toxic = 1"))
    rows = Library.refresh(rows, labels.where("quality = 1"), F.lit("2024-05-01"))
    return rows.select("doc_id", "status", F.col("last_legal_refresh_date").alias("refreshed"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'ring')")
def library_search(spark, sf):
    rows = table(spark, sf, "part").withColumn("title", F.col("p_name"))
    return lifecycle.search(rows, "Ring", p_type="ECONOMY").select("p_partkey", "p_name")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def intake_stream(spark, sf):
    """Contents that arrive as a stream, each once; the same as in one batch."""
    base = scratch(spark, "stream")
    docs = table(spark, sf, "documents")
    # the table is a file or a folder of files; a stream takes folders and patterns
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parquet*")
    intake.to_table(intake.first_of_content(stream.select("doc_id", "text"), "text").select("sha256"), f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema("sha256 string").parquet(f"{base}/rows")


@query("SELECT sha256(text) AS sha256, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def index_stream(spark, sf):
    """An index of contents that a stream keeps up to date: a delta for each micro-batch, the last row of a key counts."""
    base, docs = scratch(spark, "index"), table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parquet*")
    index = keyed.KeyedIndex(spark, f"{base}/index", "sha256", f"sha256 string, doc_id {dict(docs.dtypes)['doc_id']}")
    intake.refresh_index(stream.select(F.sha2("text", 256).alias("sha256"), "doc_id"), index, f"{base}/state", "doc_id").awaitTermination()
    return index.read()


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def index_repair(spark, sf):
    """An index in which some rows are wrong, some are too many and some are missing, made equal to what is stored."""
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    index = keyed.KeyedIndex(spark, scratch(spark, "index"), "doc_id", "doc_id long, sha256 string")
    index.upsert(rows.where("doc_id % 41 <> 5"))
    index.upsert(rows.where("doc_id % 97 = 0").select((F.col("doc_id") * F.when(F.col("doc_id") % 2 == 0, -1).otherwise(1)).alias("doc_id"), F.lit("damaged").alias("sha256")))
    index.repair(rows)
    return index.read()


@query(
    """WITH e AS (SELECT user_id AS asset, ts AS x, CASE event_type WHEN 'signup' THEN 'staged' ELSE 'decided' END AS event FROM events WHERE event_type IN ('signup', 'purchase')),
t AS (SELECT *, count(*) FILTER (event = 'decided') OVER (PARTITION BY asset ORDER BY x, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM e),
p AS (SELECT asset, turn, min(x) FILTER (event = 'staged') AS since, max(x) FILTER (event = 'decided') AS decided FROM t GROUP BY ALL),
q AS (SELECT *, since + INTERVAL 12 HOUR AS due, coalesce(decided, (SELECT date_trunc('millisecond', max(x)) FROM e)) > since + INTERVAL 12 HOUR AS reminded FROM p WHERE since IS NOT NULL)
SELECT asset, since, 'reminder' AS event, due AS "at", false AS late FROM q WHERE reminded UNION ALL SELECT asset, since, 'decided', decided, reminded FROM q WHERE decided IS NOT NULL"""
)
def wait_states(spark, sf):
    """Users who wait from a sign-up to their next purchase, as a stream with a state and a timer for each of them."""
    base, rows = scratch(spark, "waits"), table(spark, sf, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parquet*").where("event_type in ('signup', 'purchase')")
    events = stream.select(F.col("user_id").alias("asset"), F.when(F.col("event_type") == "signup", "staged").otherwise("decided").alias("event"), F.col("ts").cast("timestamp").alias("at"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, waits.STORE)
    try:
        out = waits.waits(events, days=0.5)
        intake.to_table(out, f"{base}/rows", f"{base}/state").awaitTermination()
    finally:
        spark.conf.set(store, before)
    kind = dict(rows.dtypes)["ts"]
    return spark.read.schema(out.schema).parquet(f"{base}/rows").withColumns({c: F.col(c).cast(kind) for c in ("since", "at")})


# --- extensions of the platform, without a counterpart ------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def revenue_cube(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).cube("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_nation(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())")
def grouping_sets(spark, sf):
    return table(spark, sf, "part").groupingSets([["p_type"], ["p_brand"], []], "p_type", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_customers(spark, sf):
    return retrieve.best(table(spark, sf, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", *long("place"))


@query("SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts GROUP BY e.event_id")
def asof_orders(spark, sf):
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    return joins.last_before(table(spark, sf, "events"), ["user_id"], "ts", bought, "last_purchase").select("event_id", "last_purchase")


@query("SELECT e.event_id, max(p.ts) AS at FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def asof_join(spark, sf):
    rows = table(spark, sf, "events")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("ts").alias("at"))
    return joins.as_of(rows.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, ["user_id"], "ts", ["at"]).select("event_id", "at")


@query("SELECT p.p_partkey, count(*) AS n FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity BETWEEN p.p_size AND p.p_size + 10 GROUP BY p.p_partkey")
def range_join(spark, sf):
    found = joins.in_range(table(spark, sf, "part"), table(spark, sf, "lineitem"), ("p_partkey", "l_partkey"), "l_quantity", F.col("p_size"), F.col("p_size") + 10)
    return found.groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS ordinal, count(*) OVER () AS of FROM documents")
def ordinals(spark, sf):
    """Places over a whole table, without a task that holds all of it."""
    return joins.with_ordinals(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", "ordinal", "of")


@query("SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey AND p_size < l_quantity + 4 AND l_quantity < p_size + 6")
def overlap_join(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_end", F.col("p_size") + 6)
    items = table(spark, sf, "lineitem").withColumn("l_end", F.col("l_quantity") + 4)
    return joins.overlapping(parts, items, ("p_partkey", "l_partkey"), ("p_size", "p_end", "l_quantity", "l_end"), 5).select("p_partkey", "l_orderkey", "l_linenumber")


@query("SELECT user_id, s AS session, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN g IS NULL OR g > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS s FROM (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS g FROM events)) GROUP BY ALL")
def session_events(spark, sf):
    rows = joins.sessions(table(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"], 3600)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def tumbling_events(spark, sf):
    return joins.tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value").select(F.col("start").alias("hour"), "event_type", "n", F.round("value", 2).alias("value"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier UNION ALL (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def set_ops(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.select(F.col("c_nationkey").alias("k")).intersectAll(s).union(s.subtract(c.where("c_acctbal > 9000").select("c_nationkey")))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def semi_anti(spark, sf):
    without = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    return without.union(table(spark, sf, "supplier").join(table(spark, sf, "lineitem").where("l_quantity = 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey"))
