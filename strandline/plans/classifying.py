"""Document types, intents, categories, product attributes and extraction, each with its oracle. The rule tables are made for the
test tables' invented prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rulebook, text
from .chunks import TYPED, lines
from .registry import query
from .views import table

TYPE_RULES = {
    "licence": {"required": ["licen[sc]e", "copyright"], "least": 1, "optional": ["permission", "warrant"], "names": ["src1"]},
    "contact": {"required": ["[a-z0-9]@[a-z]", "[0-9]{3}-[0-9]{4}"], "least": 1, "optional": ["tel", "mail"], "names": ["src2"]},
    "reference": {"required": ["https?://", "www[.]"], "least": 1, "optional": ["see"], "names": ["src3"]},
    "german": {"required": [" der ", " die ", " und "], "least": 3, "optional": [" zu ", " von "], "names": []},
    "romance": {"required": [" de ", " la ", " que "], "least": 2, "optional": [" les ", " el "], "names": []},
    "english": {"required": [" the ", " and ", " of "], "least": 2, "optional": [" that ", " with "], "names": ["src5"]},
}
SHORTCUTS = {"^src7$": "manual", "^src1[0-9]$": "archive"}
INTENT_RULES = {"whereabouts": ["where", " wh"], "naming": ["tion", "ment"], "joining": [" and ", " und ", " et "], "pointing": [" the ", " der ", " la "], "counting": ["[0-9]+"]}
CATEGORIES = {"numbers": ["one", "two", "12"], "articles": ["the", "der", "la"], "links": ["and", "und", "et"]}
CODE = "E[0-9]{2,4}"


def _hits(col: str, p: str) -> str:
    return f"len(regexp_extract_all({col}, '{p}'))"


def _plus(parts: list[str]) -> str:
    return " + ".join(["0", *parts])


def _type_sql(name_sql: str, weighted: bool) -> str:
    scored = []
    for place, (kind, r) in enumerate(TYPE_RULES.items()):
        if weighted:
            points = _plus([f"CASE WHEN {_hits('low', p)} > 0 THEN 10 + 2 * {_hits('low', p)} ELSE 0 END" for p in r["required"]] + [f"CASE WHEN regexp_matches(low, '{p}') THEN 3 ELSE 0 END" for p in r["optional"]])
            factor = " * ".join(["1.0::DOUBLE", *[f"CASE WHEN regexp_matches(lower({name_sql}), '{p}') THEN 1.5::DOUBLE ELSE 1.0 END" for p in r["names"]]])
            enough = _plus([f"({_hits('low', p)} > 0)::INT" for p in r["required"]])
            score = f"CASE WHEN {enough} >= {r['least']} THEN ({points}) * {factor} ELSE 0.0 END"
        else:
            score = "(" + _plus([f"CASE WHEN regexp_matches(low, '{p}') THEN 2 ELSE 0 END" for p in r["required"]] + [f"CASE WHEN regexp_matches(low, '{p}') THEN 1 ELSE 0 END" for p in r["optional"]]) + ")"
        scored.append(f"{{'score': ({score})::DOUBLE, 'place': {-place}, 'name': '{kind}'}}")
    return f"list_max([{', '.join(scored)}])"


@query(f"""WITH d AS (SELECT doc_id, source, lower(text) AS low FROM documents), b AS (SELECT doc_id, {_type_sql('source', True)} AS b FROM d)
    SELECT doc_id, CASE WHEN b.score > 0 THEN b.name ELSE 'general' END AS type, round(CASE WHEN b.score > 0 THEN least(1, b.score / 100) ELSE 0.3 END, 6) AS confidence FROM b""")
def c01_document_type(spark, sf_dir):
    t = rulebook.document_type(F.col("text"), F.col("source"), TYPE_RULES)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.type", F.round("t.confidence", 6).alias("confidence"))


@query(f"""WITH d AS (SELECT doc_id, source, lower(text) AS low FROM documents), b AS (SELECT doc_id, source, {_type_sql('source', False)} AS b FROM d)
    SELECT doc_id, CASE WHEN regexp_matches(source, '^src7$') THEN 'manual' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'archive' WHEN b.score > 0 THEN b.name ELSE 'general' END AS type FROM b""")
def c02_enriched_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rulebook.enriched_type(F.col("text"), F.col("source"), TYPE_RULES, SHORTCUTS).alias("type"))


PATHS = {"[?]page=": "listing", "^https?://m[.]": "mobile", "#[a-z]+$": "anchor", "/(fr|de|es)/": "translated"}


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '[?]page=') THEN 'listing' WHEN regexp_matches(lower(url), '^https?://m[.]') THEN 'mobile'
    WHEN regexp_matches(lower(url), '#[a-z]+$') THEN 'anchor' WHEN regexp_matches(lower(url), '/(fr|de|es)/') THEN 'translated' ELSE 'page' END AS type FROM pages""")
def c03_type_by_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(rulebook.first_match(F.col("url"), PATHS), F.lit("page")).alias("type"))


_SCORES = ", ".join(f"{{'score': least(1.0, CASE WHEN {_plus([_hits('low', p) for p in ps])} > 0 THEN 0.5 + 0.2 * ({_plus([_hits('low', p) for p in ps])}) ELSE 0 END)::DOUBLE, 'place': {-i}, 'name': '{n}'}}" for i, (n, ps) in enumerate(INTENT_RULES.items()))


@query(f"""WITH c AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user'),
    r AS (SELECT conv_id, turn, regexp_matches(upper(text), '{CODE}') AS coded, list_reverse_sort(list_filter([{_SCORES}], lambda x: x.score > 0)) AS l FROM c)
    SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN l[1].name WHEN coded THEN 'error_code' ELSE 'general' END AS "primary",
        array_to_string(list_transform(list_filter(l[2:], lambda x: x.score >= l[1].score - 0.3 - 1e-9)[1:2], lambda x: x.name), ',') AS secondaries,
        round(least(1.0, CASE WHEN len(l) = 0 THEN 0.3 ELSE l[1].score END + CASE WHEN coded THEN 0.1 ELSE 0 END), 6) AS confidence FROM r""")
def c06_labelled_intents(spark, sf_dir):
    i = rulebook.labelled_intents(F.col("text"), INTENT_RULES, CODE, "error_code")
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", i.alias("i"))
    return c.select("conv_id", "turn", "i.primary", F.array_join("i.secondaries", ",").alias("secondaries"), "i.confidence")


_WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')"


@query(f"SELECT conv_id, turn, CASE " + " ".join(f"WHEN list_has_any({_WORDS}, {ws}) THEN '{n}'" for n, ws in CATEGORIES.items()) + " END AS category FROM conversations")
def c07_first_category(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rulebook.first_category(text.words(F.col("text")), CATEGORIES).alias("category"))


FAMILIES = {"ring": "fastener", "bolt": "fastener", "widget": "device", "gear": "drive"}
COLOURS = {"red|blue": "network", "green": "standalone"}


def _attributes(p):
    """Category, kind, connection, platforms and module flag of a product, from its names."""
    category = F.coalesce(rulebook.first_match(F.col("p_name"), FAMILIES), F.lit("other"))
    kind = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "offer").when(F.col("p_size") > 25, "large").otherwise("plain")
    method = F.when(F.col("p_type") == "PROMO", "standalone").otherwise(F.coalesce(rulebook.first_match(F.col("p_name"), COLOURS), F.lit("wired")))
    platforms = F.when(method == "network", F.array(F.lit("controller"), F.col("p_brand"))).when(method == "standalone", F.array().cast("array<string>")).otherwise(F.array(F.lit("cable")))
    return p.select("p_partkey", category.alias("category"), kind.alias("kind"), method.alias("method"), F.array_join(platforms, "+").alias("platforms"), ((F.col("p_size") % 10 == 0) | F.col("p_name").contains("gear")).alias("modular"))


@query("""WITH m AS (SELECT *, CASE WHEN p_type = 'PROMO' THEN 'standalone' WHEN regexp_matches(lower(p_name), 'red|blue') THEN 'network' WHEN contains(lower(p_name), 'green') THEN 'standalone' ELSE 'wired' END AS method FROM part)
    SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'fastener' WHEN contains(lower(p_name), 'bolt') THEN 'fastener' WHEN contains(lower(p_name), 'widget') THEN 'device' WHEN contains(lower(p_name), 'gear') THEN 'drive' ELSE 'other' END AS category,
        CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'offer' WHEN p_size > 25 THEN 'large' ELSE 'plain' END AS kind, method,
        CASE method WHEN 'network' THEN 'controller+' || p_brand WHEN 'standalone' THEN '' ELSE 'cable' END AS platforms, p_size % 10 = 0 OR contains(p_name, 'gear') AS modular FROM m""")
def c09_c10_c11_product_attributes(spark, sf_dir):
    return _attributes(table(spark, sf_dir, "part"))


CAPABILITIES = {"ECO": ["save", "idle"], "PROMO": ["display"], "S": ["standard"], "L": ["lift", "wide"]}


@query("""WITH c(prefix, listed) AS (VALUES ('ECO', ['save', 'idle']), ('PROMO', ['display']), ('S', ['standard']), ('L', ['lift', 'wide']))
    SELECT p_partkey, array_to_string(coalesce(list_sort(flatten(list(listed) FILTER (prefix IS NOT NULL))), []), ',') AS capabilities FROM part LEFT JOIN c ON starts_with(p_type, prefix) GROUP BY p_partkey""")
def c12_capabilities(spark, sf_dir):
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(F.col("p_type").startswith(p), F.array(*map(F.lit, listed))).otherwise(none) for p, listed in CAPABILITIES.items()])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(found), ",").alias("capabilities"))


# -- extraction --------------------------------------------------------------------------------------------------------------


def _all(c, p, group=0):
    return F.regexp_extract_all(c, F.lit(p), F.lit(group))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[0-9]{3,}'))), ',') AS numbers FROM pages")
def x01_part_numbers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(_all("html", "[0-9]{3,}"))), ",").alias("numbers"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS name, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
    coalesce(nullif(regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<img[^>]* src="([^"]*)"', 1), ''), 'none') AS image,
    trim(regexp_replace(regexp_extract(html, '<p>((?s:.{1,300}))', 1), '<[^>]*>?', ' ', 'g')) AS description, len(regexp_extract_all(html, '<a href="[^"]*"')) AS links FROM pages""")
def x03_page_fields(spark, sf_dir):
    one = lambda p: F.regexp_extract("html", p, 1)
    some = lambda p: F.when(one(p) != "", one(p))
    image = F.coalesce(some('<meta property="og:image" content="([^"]*)"'), some('<img[^>]* src="([^"]*)"'), F.lit("none"))
    described = F.trim(F.regexp_replace(one("<p>((?s:.{1,300}))"), "<[^>]*>?", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(one("<title>([^<]*)</title>")).alias("name"), one('<html lang="([a-z]*)"').alias("lang"), image.alias("image"), described.alias("description"), rulebook.hits(F.col("html"), '<a href="[^"]*"').cast("long").alias("links"))


_SPEC = "p_name || '. Torque: ' || p_size || ' to ' || (p_size + 10) || ' Nm. Weight: ' || p_size || '.5 kg. Speed: ' || (p_size * 10) || ' rpm. Firmware: v' || (p_size % 4) || '.' || (p_size % 9) || '. Wireless: ' || CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END"


def spec_texts(spark, sf_dir):
    s = F.col("p_size")
    said = F.concat("p_name", F.lit(". Torque: "), s, F.lit(" to "), s + 10, F.lit(" Nm. Weight: "), s, F.lit(".5 kg. Speed: "), s * 10, F.lit(" rpm. Firmware: v"), s % 4, F.lit("."), s % 9, F.lit(". Wireless: "), F.when(s % 2 == 0, "yes").otherwise("no"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", said.alias("spec"))


@query(f"""WITH s AS (SELECT p_partkey, {_SPEC} AS spec FROM part)
    SELECT p_partkey, regexp_extract(spec, '([0-9]+) ?rpm', 1)::BIGINT AS speed, regexp_extract(spec, 'Weight: ([0-9.]+) ?kg', 1)::DOUBLE AS weight, regexp_extract(spec, 'v([0-9]+[.][0-9]+)', 1) AS firmware,
        regexp_matches(lower(spec), 'wireless: yes') AS wireless, CASE WHEN regexp_extract(spec, 'Torque: ([0-9]+)', 1)::BIGINT > 30 THEN '3/4' WHEN regexp_extract(spec, 'Torque: ([0-9]+)', 1)::BIGINT > 10 THEN '1/2' ELSE '1/4' END AS drive FROM s""")
def x05_spec_fields(spark, sf_dir):
    one = lambda p: F.regexp_extract("spec", p, 1)
    torque = one("Torque: ([0-9]+)").cast("long")
    return spec_texts(spark, sf_dir).select("p_partkey", one("([0-9]+) ?rpm").cast("long").alias("speed"), one("Weight: ([0-9.]+) ?kg").cast("double").alias("weight"), one("v([0-9]+[.][0-9]+)").alias("firmware"), F.lower("spec").rlike("wireless: yes").alias("wireless"), F.when(torque > 30, "3/4").when(torque > 10, "1/2").otherwise("1/4").alias("drive"))


#: pattern -> family and category, in order.
MENTIONS = [("anand?", "AN", "joint"), ("thou[a-z]*", "TH", "pronoun"), ("[a-z]*tion", "TION", "noun"), ("wh[a-z]+", "WH", "question")]


@query("WITH r(pattern, family, category, place) AS (VALUES " + ", ".join(f"('{p}', '{f}', '{c}', {i})" for i, (p, f, c) in enumerate(MENTIONS)) + """),
    h AS (SELECT doc_id, family, category, place, regexp_extract_all(lower(text), pattern) AS m FROM documents, r)
    SELECT doc_id, family, category, len(m) AS n, len(list_distinct(m)) AS forms, CASE WHEN len(m) >= 10 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1 AS first FROM h WHERE len(m) > 0""")
def x06_mentions(spark, sf_dir):
    """All matches of a short table of patterns, one row per document and family; the first of the table is marked."""
    low = F.lower("text")
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("category"), _all(low, p).alias("m")) for p, f, c in MENTIONS])
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(rows, lambda x: F.size(x["m"]) > 0)).alias("at", "x"))
    n = F.size("x.m")
    return found.select("doc_id", "x.family", "x.category", n.cast("long").alias("n"), F.size(F.array_distinct("x.m")).cast("long").alias("forms"), F.when(n >= 10, 0.95).otherwise(0.7).alias("confidence"), (F.col("at") == 0).alias("first"))


KEYWORDS = {"licen[sc]e": "legal", "@[a-z]": "mail", "https?://": "link", "tion": "prose"}
VARIANTS = {"AN": ["anand", "anon"], "TH": ["thth", "thou"], "EAU": ["eau", "oi"]}


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'legal' WHEN regexp_matches(lower(text), '@[a-z]') THEN 'mail' WHEN regexp_matches(lower(text), 'https?://') THEN 'link' WHEN contains(lower(text), 'tion') THEN 'prose' END AS product,
    CASE WHEN contains(k, 'anand') OR contains(k, 'anon') THEN 'AN' WHEN contains(k, 'thth') OR contains(k, 'thou') THEN 'TH' WHEN contains(k, 'eau') OR contains(k, 'oi') THEN 'EAU' END AS family
    FROM (SELECT *, lower(source || ' ' || text) AS k FROM documents)""")
def x07_x08_keyword_families(spark, sf_dir):
    named = F.lower(F.concat("source", F.lit(" "), "text"))
    family = F.coalesce(*[F.when(F.coalesce(*[F.when(named.contains(v), True) for v in vs], F.lit(False)), f) for f, vs in VARIANTS.items()], F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", rulebook.first_match(F.col("text"), KEYWORDS).alias("product"), family.alias("family"))


@query(f"""WITH d AS (SELECT doc_id, list_sort(list_intersect(list_distinct({_WORDS}), ['an', 'ou', 'ci', 'der'])) AS f FROM documents)
    SELECT doc_id, array_to_string(f, ',') AS families, CASE WHEN len(f) > 1 THEN 'generic' WHEN len(f) = 1 THEN f[1] END AS family FROM d""")
def x09_family_scan(spark, sf_dir):
    """Whole words among a document's; more than one family makes it generic."""
    f = F.array_sort(F.array_intersect(F.array_distinct(text.words(F.col("text"))), F.array(*map(F.lit, ["an", "ou", "ci", "der"]))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(f, ",").alias("families"), F.when(F.size(f) > 1, "generic").otherwise(F.get(f, F.lit(0))).alias("family"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text), '[A-Z]{1,3}-?[0-9]{2,4}'))), ',') AS codes, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z]{3,5}[0-9]+'))), ',') AS models FROM documents")
def x10_x18_codes_and_models(spark, sf_dir):
    codes, models = _all(F.upper("text"), "[A-Z]{1,3}-?[0-9]{2,4}"), _all("text", "[A-Z]{3,5}[0-9]+")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(codes)), ",").alias("codes"), F.array_join(F.array_sort(F.array_distinct(models)), ",").alias("models"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '([A-Z][a-z]+)[.,]', 1), ''), nullif(regexp_extract(text, '^([A-Z][a-z]+)', 1), '')) AS model, nullif(regexp_extract(text, '([0-9]+)', 1), '') AS number,
    nullif(regexp_extract(text, '([a-z]+tion)', 1), '') AS object, nullif(regexp_extract(text, '([a-z0-9._]+@[a-z0-9.]+)', 1), '') AS mail FROM conversations WHERE role = 'user'""")
def x13_query_entities(spark, sf_dir):
    some = lambda p: F.when(F.regexp_extract("text", p, 1) != "", F.regexp_extract("text", p, 1))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce(some("([A-Z][a-z]+)[.,]"), some("^([A-Z][a-z]+)")).alias("model"), some("([0-9]+)").alias("number"), some("([a-z]+tion)").alias("object"), some("([a-z0-9._]+@[a-z0-9.]+)").alias("mail"))


VOCABULARY = {"series": ["thou", "eau", "wh"], "parts": ["tion", "ment", "ing"], "actions": ["is", "are", "was"]}


@query("SELECT doc_id, " + ", ".join("array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in ts) + f"], lambda w: contains(lower(text), w)), ',') AS {n}" for n, ts in VOCABULARY.items()) + " FROM documents")
def x14_domain_entities(spark, sf_dir):
    v = rulebook.vocabulary_terms(F.col("text"), VOCABULARY)
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", *[F.array_join(f"v.{n}", ",").alias(n) for n in VOCABULARY])


@query(f"""WITH {TYPED}, f AS (SELECT doc_id, i, kind, line, regexp_extract(line, '^([0-9]+)', 1) AS number FROM t),
    s AS (SELECT doc_id, number, min(i) AS i FROM f WHERE kind = 'step' GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind = 'problem') AS causes, count(*) FILTER (kind = 'solution') AS solutions,
        (SELECT count(*) FROM s WHERE s.doc_id = f.doc_id) AS steps, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kind = 'warning'), '')) AS warned FROM f GROUP BY doc_id""")
def x15_patterns(spark, sf_dir):
    """What a document's lines tell without a model: warnings, causes, solutions, and steps, the first of each number."""
    t = lines(spark, sf_dir)
    kind = F.col("kind")
    warned = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == "warning", F.struct("i", "line")))), lambda x: x["line"]), "\n")
    return t.groupBy("doc_id").agg(F.count_if(kind == "warning").alias("warnings"), F.count_if(kind == "problem").alias("causes"), F.count_if(kind == "solution").alias("solutions"), F.count_distinct(F.when(kind == "step", F.regexp_extract("line", "^([0-9]+)", 1))).alias("steps"), F.md5(warned).alias("warned"))
