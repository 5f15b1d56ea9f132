"""Queries that parse, classify and count web pages and texts, as one does for a catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import encode as E
from ..operators import catalogue as Q
from .book import add


def _pages(s, d):
    return E.table(s, d, "pages")


def _links(s, d):
    pair = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(1)), F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(2))
    found = _pages(s, d).select("page_id", F.explode(F.arrays_zip(pair[0].alias("href"), pair[1].alias("name"))).alias("a"))
    return found.select("page_id", F.col("a.href").alias("href"), F.col("a.name").alias("name"))


LINKS_SQL = """links AS (SELECT page_id, regexp_extract(t, '<a href="([^"]*)">', 1) AS href, regexp_extract(t, '>([^<]*)<', 1) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS t FROM pages))"""
add("link_anchors", _links, f"WITH {LINKS_SQL} SELECT * FROM links")
add(
    "canonical_names",
    lambda s, d: _links(s, d).groupBy("href").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count("*").alias("n")),
    f"WITH {LINKS_SQL} SELECT href, arg_min(name, {{'n': length(name), 'name': name}}) AS name, count(*) AS n FROM links GROUP BY href",
)


def _stripped():
    text = F.regexp_replace("html", r"<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "<!--.*?-->", " "), "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


STRIP_SQL = r"""regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    STRIP_SQL = f"replace({STRIP_SQL}, '{_name}', '{_sign}')"
STRIP_SQL = rf"trim(regexp_replace({STRIP_SQL}, '[ \t\n\r]+', ' ', 'g'))"
add("html_strip", lambda s, d: _pages(s, d).select("page_id", _stripped().alias("text")), f"SELECT page_id, {STRIP_SQL} AS text FROM pages")

HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


def _status():
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return F.when(host == "", "unknown").when(F.col("url").startswith("http://"), "legacy").when(host.startswith("blog.") | host.startswith("m."), "mirror").otherwise("active")


STATUS_SQL = f"CASE WHEN {HOST} = '' THEN 'unknown' WHEN starts_with(url, 'http://') THEN 'legacy' WHEN starts_with({HOST}, 'blog.') OR starts_with({HOST}, 'm.') THEN 'mirror' ELSE 'active' END"
add(
    "url_status",
    lambda s, d: _pages(s, d).select(_status().alias("status"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts")),
    f"SELECT {STATUS_SQL} AS status, count(*) AS n, count(DISTINCT {HOST}) AS hosts FROM pages GROUP BY 1",
)


def _entries(s, d):
    """Catalogue entries out of the parts: ``entry, name, text, code, url, other``, with years, languages, answers of hosts and addresses that its numbers give."""
    k = F.col("p_partkey")
    year = (1962 + (k * 7) % 70).cast("string")
    said = (
        F.when(k % 7 == 0, F.concat(F.lit(" Released on a tape at the end of "), year, F.lit(".")))
        .when(k % 7 == 1, F.concat(F.lit(" It is at version 2.1b ("), year, F.lit(")")))
        .when(k % 7 == 2, F.concat(F.lit(" It was made in "), year, F.lit(" and later")))
        .when(k % 7 == 3, F.concat(F.lit(" See Smith, "), year, F.lit(". for more")))
        .when(k % 7 == 4, F.concat(F.lit(" From "), (2000 + k % 20).cast("string"), F.lit(" to "), year))
        .otherwise(F.lit(""))
    )
    tongue = F.element_at(F.array(*map(F.lit, (" written in C", " with Java and Perl", " an R package in FORTRAN", " a c program or python", ""))), (k % 5 + 1).cast("int"))
    host = F.element_at(F.array(*map(F.lit, ("github.com/x", "www.example.org", "sourceforge.net/p", "Lab.example.edu", "cran.r-project.org"))), (k % 5 + 1).cast("int"))
    code = F.element_at(F.array(*(F.lit(c).cast("int") for c in (200, 404, 301, None, 503, 200))), (k % 6 + 1).cast("int"))
    return E.table(s, d, "part").select(
        F.col("p_partkey").alias("entry"), F.col("p_name").alias("name"), F.concat("p_name", tongue, said).alias("text"), code.alias("code"),
        F.concat(F.lit("http://"), host, F.lit("/"), k.cast("string")).alias("url"), F.concat(F.lit("http://www.example.com/"), (k % 3).cast("string")).alias("other"),
    )


ENTRIES_SQL = """entries AS (SELECT p_partkey AS entry, p_name AS name, p_name || [' written in C', ' with Java and Perl', ' an R package in FORTRAN', ' a c program or python', ''][1 + p_partkey % 5] ||
    CASE p_partkey % 7 WHEN 0 THEN ' Released on a tape at the end of ' || y || '.' WHEN 1 THEN ' It is at version 2.1b (' || y || ')' WHEN 2 THEN ' It was made in ' || y || ' and later'
      WHEN 3 THEN ' See Smith, ' || y || '. for more' WHEN 4 THEN ' From ' || (2000 + p_partkey % 20) || ' to ' || y ELSE '' END AS text, [200, 404, 301, NULL, 503, 200][1 + p_partkey % 6] AS code,
    'http://' || ['github.com/x', 'www.example.org', 'sourceforge.net/p', 'Lab.example.edu', 'cran.r-project.org'][1 + p_partkey % 5] || '/' || p_partkey AS url, 'http://www.example.com/' || p_partkey % 3 AS other
    FROM (SELECT *, (1962 + p_partkey * 7 % 70)::VARCHAR AS y FROM part))"""


def _dated(s, d):
    year, method = Q.first_year(F.col("text"))
    return _entries(s, d).select("entry", "name", year.alias("year"), method.alias("method"), Q.status(F.col("code"), F.col("url")).alias("status"), Q.languages(F.col("text")).alias("langs"))


_YEAR, _METHOD = Q.first_year_sql("text")
DATED_SQL = f"""{ENTRIES_SQL}, dated AS (SELECT entry, name, {_YEAR} AS year, {_METHOD} AS method, {Q.status_sql("code", "url")} AS status, {Q.languages_sql("text")} AS langs FROM entries)"""
def _era():
    return F.when(F.col("year") < 1990, "1980s or before").when(F.col("year") < 2000, "1990s").when(F.col("year") < 2010, "2000s").otherwise("later")
ERA_SQL = "CASE WHEN year < 1990 THEN '1980s or before' WHEN year < 2000 THEN '1990s' WHEN year < 2010 THEN '2000s' ELSE 'later' END"
add("release_year", lambda s, d: _dated(s, d).select("entry", "year", "method"), f"WITH {DATED_SQL} SELECT entry, year, method FROM dated")
add("entry_status", lambda s, d: _dated(s, d).groupBy("status").agg(F.count("*").alias("n")), f"WITH {DATED_SQL} SELECT status, count(*) AS n FROM dated GROUP BY status")
add(
    "entry_languages",
    lambda s, d: _dated(s, d).select("entry", F.array_join("langs", ",").alias("langs"), F.size("langs").alias("n")),
    f"WITH {DATED_SQL} SELECT entry, array_to_string(langs, ',') AS langs, len(langs)::INTEGER AS n FROM dated",
)
add(
    "metadata_coverage",
    lambda s, d: _dated(s, d).agg(F.count("*").alias("n"), F.count("year").alias("with_year"), F.count_if(F.size("langs") > 0).alias("with_language"), F.round(100 * F.count("year") / F.count("*"), 4).alias("year_percent")),
    f"WITH {DATED_SQL} SELECT count(*) AS n, count(year) AS with_year, count(*) FILTER (len(langs) > 0) AS with_language, round(100 * count(year) / count(*)::DOUBLE, 4) AS year_percent FROM dated",
)


def _bins(s, d):
    bins = _dated(s, d).where("year is not null").groupBy((F.floor(F.col("year") / 5) * 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    peak = bins.agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak"))
    return bins.join(F.broadcast(peak)).select("bin", "n", (F.col("bin") == F.col("peak")).alias("peak"))


add(
    "year_bins",
    _bins,
    f"WITH {DATED_SQL}, b AS (SELECT (year // 5 * 5)::INTEGER AS bin, count(*) AS n FROM dated WHERE year IS NOT NULL GROUP BY 1) SELECT bin, n, bin = (SELECT bin FROM b ORDER BY n DESC, bin LIMIT 1) AS peak FROM b",
)
add(
    "era_survival",
    lambda s, d: _dated(s, d).where("year is not null").groupBy(_era().alias("era")).agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("status") != "dead").cast("double")), 4).alias("alive_percent")),
    f"WITH {DATED_SQL} SELECT {ERA_SQL} AS era, count(*) AS n, round(100 * avg((status <> 'dead')::INTEGER), 4) AS alive_percent FROM dated WHERE year IS NOT NULL GROUP BY 1",
)
add(
    "language_by_era",
    lambda s, d: _dated(s, d).where("year is not null").select(_era().alias("era"), F.explode("langs").alias("language")).groupBy("language").pivot("era", ["1980s or before", "1990s", "2000s", "later"]).count().na.fill(0),
    f"""WITH {DATED_SQL} SELECT language, {", ".join(f"count(*) FILTER (era = '{e}') AS \"{e}\"" for e in ("1980s or before", "1990s", "2000s", "later"))} FROM (SELECT {ERA_SQL} AS era, unnest(langs) AS language FROM dated WHERE year IS NOT NULL) GROUP BY language""",
)


def _addresses(s, d):
    found = _entries(s, d).select(F.element_at(F.split("name", " "), 1).alias("name"), "entry", F.posexplode(F.array("other", "url")).alias("k", "url"))
    return found.select("name", (2 * F.col("entry") + F.col("k")).alias("place"), "url")


add(
    "best_urls",
    lambda s, d: Q.best_urls(_addresses(s, d)),
    f"""WITH {ENTRIES_SQL}, a AS (SELECT split_part(name, ' ', 1) AS name, 2 * entry AS place, other AS url FROM entries UNION ALL SELECT split_part(name, ' ', 1), 2 * entry + 1, url FROM entries)
    SELECT name, arg_min(url, {{'a': NOT ({" OR ".join(f"contains(lower(url), '{h}')" for h in Q.HOMES)}), 'b': place}}) AS url, count(*) AS n FROM a GROUP BY name""",
)


def _anchors(s, d):
    k = F.col("p_partkey")
    return E.table(s, d, "part").select(F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.replace(F.upper("p_name"), F.lit(" "), F.lit("_"))).when(k % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.concat("p_name", F.lit("?"))).alias("anchor"))


add(
    "matched_names",
    lambda s, d: Q.matched_names(_anchors(s, d), E.table(s, d, "part").select(F.col("p_name").alias("name"))),
    """WITH a AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(upper(p_name), ' ', '_') WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name || '?' END AS anchor FROM part),
    k AS (SELECT lower(p_name) AS key, min(p_name) AS name FROM part GROUP BY 1), f AS (SELECT anchor, 0 AS rank, anchor AS form FROM a
      UNION ALL SELECT anchor, 1, replace(anchor, '_', ' ') FROM a UNION ALL SELECT anchor, 2, replace(anchor, '-', ' ') FROM a),
    m AS (SELECT anchor, arg_min(name, rank) AS name, min(rank)::INTEGER AS rank FROM f JOIN k ON lower(form) = key GROUP BY anchor) SELECT a.anchor, name, rank FROM a LEFT
      JOIN m ON a.anchor = m.anchor""",
)
add(
    "faceted_search",
    lambda s, d: E.table(s, d, "documents").where(F.col("lang").isin("en", "fr") & F.contains(F.lower("text"), F.lit("tion"))).groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")),
    "SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents WHERE lang IN ('en', 'fr') AND contains(lower(text), 'tion') GROUP BY lang, source",
)
add(
    "search_page",
    lambda s, d: E.table(s, d, "documents").where(F.contains(F.lower("text"), F.lit("tion"))).orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "lang", "n_chars").offset(20).limit(20),
    "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'tion') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20",
)
add(
    "top_sources",
    lambda s, d: E.table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).orderBy(F.desc("chars"), "source").limit(15),
    "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 15",
)
add(
    "value_summary",
    lambda s, d: E.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.median("value"), 6).alias("median")),
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median FROM events GROUP BY event_type",
)


def _notices(s, d):
    """Entries as catalogues print them, out of the suppliers and their nations: ``entry, text``."""
    k, where = F.col("s_suppkey"), F.initcap("n_name")
    kinds = (
        F.concat(F.lit("Ana "), where, F.lit(" and Bo Lee of the Department of Genetics, University of "), where, F.lit(" (ana@example.org) has written it in C++ 11 and Perl.")),
        F.concat(F.lit("Bo Lee, at the University of "), where, F.lit(", has released a JavaScript tool and an R library.")),
        F.lit("Cy Diaz & (cy@example.org) in Java Script and GNU C"),
        F.lit("the group of nobody"),
        F.concat(F.lit("Dr. Eve "), where, F.lit(" of Paris made a Ruby and Visual Basic program at the Museum of "), where, F.lit(" History Museum. It needs Matlab.")),
        F.concat(where, F.lit(" of the Institute for Trees, "), where, F.lit(" College has Delphi and Java code.")),
    )
    said = F.element_at(F.array(*kinds), (k % len(kinds) + 1).cast("int"))
    joined = E.table(s, d, "supplier").join(F.broadcast(E.table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(k.alias("entry"), said.alias("text"))


NOTICES_SQL = """notices AS (SELECT entry, [
  'Ana ' || w || ' and Bo Lee of the Department of Genetics, University of ' || w || ' (ana@example.org) has written it in C++ 11 and Perl.',
  'Bo Lee, at the University of ' || w || ', has released a JavaScript tool and an R library.',
  'Cy Diaz & (cy@example.org) in Java Script and GNU C',
  'the group of nobody',
  'Dr. Eve ' || w || ' of Paris made a Ruby and Visual Basic program at the Museum of ' || w || ' History Museum. It needs Matlab.',
  w || ' of the Institute for Trees, ' || w || ' College has Delphi and Java code.'][1 + entry % 6] AS text
  FROM (SELECT s_suppkey AS entry, list_aggregate(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS w FROM supplier
      JOIN nation ON s_nationkey = n_nationkey))"""
add(
    "entry_people",
    lambda s, d: _notices(s, d).select("entry", Q.authors(F.col("text")).alias("authors"), Q.institution(F.col("text")).alias("institution"), F.array_join(Q.languages(F.col("text")), ",").alias("langs")),
    f"""WITH {NOTICES_SQL} SELECT entry, {Q.authors_sql("text")} AS authors, {Q.institution_sql("text")} AS institution, array_to_string({Q.languages_sql("text")}, ',') AS langs FROM notices""",
)
