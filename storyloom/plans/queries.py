"""One query for each operator group over the driver's tables, with its SQL.

Roles of the tables: documents are chunks, conversations make works with chapters and scenes, benchmark items
make a catalog, embeddings are vectors (ids divisible by 100: queries; label: scene), events are findings and log
entries (user_id: scene, event_type: motif, value: confidence), labels are decisions. Every query reads whole
tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.config import CalibrationConfig, ChunkConfig, GazetteerConfig, JudgeConfig
from storyloom.functions import numbers as N
from storyloom.functions import text as T
from storyloom.operators import analytics, calibrate, catalog, gazetteer, judge, review, segment, spans, tables, validate, vectors
from storyloom.sources import files

QUERIES = {}
ORACLES = {}
SMALL = ChunkConfig(target=45, least=30, most=60, overlap=8, look_ahead=10)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- shared inputs

WORKS_SQL = "works AS (SELECT conv_id AS work_id, string_agg('Chapter ' || (turn + 1) || chr(10) || coalesce(text, '') || chr(10) || '***' || chr(10) || 'after' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def works(spark, d):
    line = F.concat(F.lit("Chapter "), (F.col("turn") + 1).cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n***\nafter\n"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("work_id")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("p"))
    return rows.select("work_id", F.array_join("p.l", "").alias("text"))


FINDINGS_SQL = "findings AS (SELECT event_id AS finding_id, user_id % 10 AS work_id, user_id AS scene_id, event_type AS motif_id, least(value / 500, 1) AS confidence, ts AS created_at, (event_id * 7) % 900 AS s, (event_id * 7) % 900 + 10 + event_id % 90 AS e FROM events)"


def findings(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("finding_id"), (F.col("user_id") % 10).alias("work_id"), F.col("user_id").alias("scene_id"), F.col("event_type").alias("motif_id"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), F.col("ts").alias("created_at"), ((F.col("event_id") * 7) % 900).alias("start"), ((F.col("event_id") * 7) % 900 + 10 + F.col("event_id") % 90).alias("end"))


LOG_SQL = "log AS (SELECT event_id AS id, event_id // 2 AS finding_id, CASE event_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END AS decision, date_trunc('day', ts) AS created_at FROM events)"


def log(spark, d):
    e = table(spark, d, "events")
    decision = F.when(F.col("event_id") % 3 == 0, "accept").when(F.col("event_id") % 3 == 1, "reject").otherwise("edit")
    return e.select(F.col("event_id").alias("id"), F.expr("event_id div 2").alias("finding_id"), decision.alias("decision"), F.date_trunc("day", "ts").alias("created_at"))


LATEST_SQL = LOG_SQL + ", latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) = 1)"
MOTIFS_SQL = "motifs AS (SELECT item_id AS motif_id, array_to_string(string_split(lower(text), ' ')[1:3], ' ') AS name, string_split(lower(text), ' ')[4:6] AS aliases, text AS summary FROM benchmark)"


def motifs(spark, d):
    w = F.split(F.lower("text"), " ")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("motif_id"), F.array_join(F.slice(w, 1, 3), " ").alias("name"), F.slice(w, 4, 3).alias("aliases"), F.col("text").alias("summary"))


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


# ---------------------------------------------------------------- sources, segmentation


@query("decode_text", "SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN text ELSE chr(65279) || text END) AS text_sha FROM documents")
def _(spark, d):
    rows = documents(spark, d)
    bom = F.lit("﻿")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode(F.concat(bom, "text"), "UTF-16LE")).otherwise(F.encode(F.concat(bom, "text"), "UTF-16BE"))
    return rows.select("doc_id", F.sha2(files.decode_column(raw).cast("binary"), 256).alias("text_sha"))


@query("normalize_text", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS norm_sha FROM (SELECT doc_id, replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10) || ' ' || chr(13) || chr(10) || chr(10) || chr(10)) AS raw FROM documents)")
def _(spark, d):
    raw = F.replace(F.col("text"), F.lit(". "), F.lit(". \t\r\n \r\n\n\n"))
    return documents(spark, d).select("doc_id", F.sha2(T.normalize_text(raw).cast("binary"), 256).alias("norm_sha"))


HEAD = r"regexp_matches(trim(content), '(?i)^(?:chapter|ch\.|book|part)\s+([ivxlcdm]+|\d+|[a-z]+)\b')"
LINES_SQL = WORKS_SQL + ", parts AS (SELECT work_id, text, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM works), lines AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY work_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM parts)"
CHAPTERS_SQL = LINES_SQL + f", heads AS (SELECT work_id, text, pos, trim(content) AS title FROM lines WHERE {HEAD}), chapters AS (SELECT work_id, row_number() OVER w - 1 AS idx, title, pos AS char_start, coalesce(lead(pos) OVER w, length(text)) AS char_end, text FROM heads WINDOW w AS (PARTITION BY work_id ORDER BY pos))"


@query("chapter_spans", f"WITH {CHAPTERS_SQL} SELECT work_id, idx::INTEGER AS idx, title, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end FROM chapters")
def _(spark, d):
    return segment.chapters(works(spark, d)).drop("text")


SCENES_SQL = CHAPTERS_SQL + r""", sl AS (SELECT c.work_id, c.idx AS chapter, c.char_start, c.char_end, c.text, l.pos, trim(l.content) AS content, row_number() OVER (PARTITION BY c.work_id, c.idx ORDER BY l.line) AS n, trim(lag(l.content) OVER (PARTITION BY c.work_id, c.idx ORDER BY l.line)) AS before FROM chapters c JOIN lines l ON c.work_id = l.work_id AND l.pos >= c.char_start AND l.pos < c.char_end),
anchors AS (SELECT *, regexp_matches(content, '^(?:\*{3,}|-{3,}|—{2,}|·{3,}|\*\s\*\s\*|#\s#\s#)\s*$') AS rule FROM sl WHERE n = 1 OR regexp_matches(content, '^(?:\*{3,}|-{3,}|—{2,}|·{3,}|\*\s\*\s\*|#\s#\s#)\s*$') OR (content = '' AND before = '')),
cut AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY work_id, chapter ORDER BY pos), char_end) AS stop FROM anchors),
full_scenes AS (SELECT work_id, chapter, row_number() OVER (PARTITION BY work_id, chapter ORDER BY pos) - 1 AS idx, pos AS char_start, stop AS char_end, CASE WHEN rule THEN content END AS heading, substr(text, pos + 1, stop - pos) AS text FROM cut WHERE trim(replace(substr(text, pos + 1, stop - pos), chr(10), ' ')) <> ''),
scenes AS (SELECT * FROM full_scenes UNION ALL SELECT work_id, idx, 0, char_start, char_end, NULL, substr(text, char_start + 1, char_end - char_start) FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM full_scenes f WHERE f.work_id = c.work_id AND f.chapter = c.idx))"""


@query("scene_spans", f"WITH {SCENES_SQL} SELECT work_id, chapter::INTEGER AS chapter, idx::INTEGER AS idx, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end, heading, sha256(text) AS text_sha FROM scenes")
def _(spark, d):
    s = segment.scenes(segment.chapters(works(spark, d)))
    return s.withColumn("text_sha", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def _sentence_sql(variant):
    if variant in "CD":
        pattern = r"((?:[.!?]|—)+\s+)" if variant == "C" else r"([.!?]\"?\s)"
        return rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
q AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM p), o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q)
SELECT doc_id, a::INTEGER AS s_start, (a + length(s))::INTEGER AS s_end FROM o WHERE length(s) > 0"""
    tail = "CASE WHEN a + length(s) = n THEN n ELSE a + length(regexp_replace(s, '\\s+$', '')) END" if variant == "B" else "a + length(regexp_replace(s, '\\s+$', ''))"
    return rf"""WITH p AS (SELECT doc_id, length(text) AS n, string_split(regexp_replace(text, '([.!?]+(?:\s+|$)|\n{{2,}})', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
q AS (SELECT doc_id, n, unnest(p) AS s, unnest(range(len(p))) AS i FROM p), o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q),
f AS (SELECT doc_id, (a + length(s) - length(regexp_replace(s, '^\s+', '')))::INTEGER AS s_start, ({tail})::INTEGER AS s_end FROM o WHERE regexp_replace(s, '\s+', '', 'g') <> '')
SELECT * FROM f UNION ALL SELECT doc_id, 0, length(text)::INTEGER FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)"""


for _variant in "ABCD":

    @query(f"sentence_spans_{_variant.lower()}", _sentence_sql(_variant))
    def _(spark, d, variant=_variant):
        rows = documents(spark, d).select("doc_id", F.explode(segment.sentences(F.col("text"), variant)).alias("s"))
        return rows.select("doc_id", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"))


@query("token_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::INTEGER AS tokens FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


CHUNKS_SQL = (
    SCENES_SQL
    + r""", toks AS (SELECT work_id, chapter, idx AS scene, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM scenes),
ends AS (SELECT *, len(t) AS n, list_filter(range(len(t)), lambda p: t[p + 1] IN ('.', '!', '?')) AS stops FROM toks WHERE len(t) > 0),
step(work_id, chapter, scene, idx, i, j) AS (
  SELECT work_id, chapter, scene, 0, 0::BIGINT, nxt(0::BIGINT, n, stops) FROM ends
  UNION ALL SELECT s.work_id, s.chapter, s.scene, s.idx + 1, greatest(0, s.j - 8), nxt(greatest(0, s.j - 8), e.n, e.stops) FROM step s JOIN ends e USING (work_id, chapter, scene) WHERE s.j < e.n
)"""
)


def _nxt(i):
    base = f"least({i} + 60, greatest(least({i} + 45, n), least(n, {i} + 30)), n)"
    first = f"list_min(list_filter(stops, lambda p: p >= {base} AND p <= least(n - 1, {base} + 10)))"
    return f"CASE WHEN {first} IS NULL THEN {base} ELSE least({first} + 1, {i} + 60) END"


CHUNKS_SQL = CHUNKS_SQL.replace("nxt(0::BIGINT, n, stops)", _nxt("0")).replace("nxt(greatest(0, s.j - 8), e.n, e.stops)", _nxt("greatest(0, s.j - 8)"))


@query("chunk_windows", f"WITH RECURSIVE {CHUNKS_SQL} SELECT work_id, chapter::INTEGER AS chapter, scene::INTEGER AS scene, idx::INTEGER AS idx, i::INTEGER AS token_start, j::INTEGER AS token_end FROM step")
def _(spark, d):
    s = segment.scenes(segment.chapters(works(spark, d))).withColumnRenamed("idx", "scene")
    return segment.chunks(s, ["work_id", "chapter", "scene"], SMALL).drop("char_start", "char_end", "text", "sha256")


@query("chunk_sha256")
def _(spark, d):
    return segment.segment(works(spark, d))["chunk"]


@query("ingest_statistics", f"WITH RECURSIVE {CHUNKS_SQL} SELECT w.work_id, coalesce(c.n, 0)::BIGINT AS chapters, coalesce(s.n, 0)::BIGINT AS scenes, coalesce(k.n, 0)::BIGINT AS chunks FROM works w LEFT JOIN (SELECT work_id, count(*) AS n FROM chapters GROUP BY 1) c USING (work_id) LEFT JOIN (SELECT work_id, count(*) AS n FROM scenes GROUP BY 1) s USING (work_id) LEFT JOIN (SELECT work_id, count(*) AS n FROM step GROUP BY 1) k USING (work_id)")
def _(spark, d):
    return segment.statistics(works(spark, d), "work_id", SMALL)


# ---------------------------------------------------------------- catalog and strings


@query("alias_split", "SELECT item_id, list_filter(list_transform(string_split(translate(text, ' .', '|;'), '|'), lambda x: trim(replace(x, ';', ''))), lambda x: x <> '') AS parts FROM (SELECT item_id, replace(text, '.', '') AS text FROM benchmark)")
def _(spark, d):
    c = F.translate(F.replace(F.col("text"), F.lit("."), F.lit("")), " ", "|")
    return table(spark, d, "benchmark").select("item_id", T.split_list(c).alias("parts"))


@query("alias_normalize", r"""SELECT item_id, trim(regexp_replace(regexp_replace(lower(trim(a)), '\s+', ' ', 'g'), '^[,.;:!?"''()\[\]{}]+|[,.;:!?"''()\[\]{}]+$', '', 'g')) AS alias FROM (SELECT item_id, '  "' || text || '!)  ' AS a FROM benchmark)""")
def _(spark, d):
    a = F.concat(F.lit('  "'), "text", F.lit("!)  "))
    return table(spark, d, "benchmark").select("item_id", T.normalize_alias(a).alias("alias"))


@query("alias_merge", f"WITH {MOTIFS_SQL} SELECT motif_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_concat(aliases, [name, 'extra'])), lambda x: x)), lambda x: x), '|') AS merged FROM motifs")
def _(spark, d):
    m = motifs(spark, d).select("motif_id", catalog.merged_aliases(F.col("aliases"), F.array("name", F.lit("extra"))).alias("a"))
    return m.select("motif_id", F.array_join(F.sort_array("a"), "|").alias("merged"))


ALIAS_SQL = r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(strip_accents(a), '[^\x00-\x7f]', '', 'g'))), '\s+', ' ', 'g'), '^[,.;:!?\"''()\[\]{}]+|[,.;:!?\"''()\[\]{}]+$', '', 'g'))".replace('\\"', '"')


@query("alias_clean", f"WITH {MOTIFS_SQL}, c AS (SELECT motif_id, name, list_transform(aliases || aliases || [name], lambda a: {ALIAS_SQL}) AS l, list_transform([name], lambda a: {ALIAS_SQL})[1] AS n FROM motifs) SELECT motif_id, name, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: length(x) >= 2 AND x <> n))), '|') AS kept FROM c")
def _(spark, d):
    m = motifs(spark, d)
    return catalog.cleaned_aliases(m.withColumn("aliases", F.concat("aliases", "aliases", F.array("name")))).select("motif_id", "name", F.array_join(F.sort_array("clean"), "|").alias("kept"))


@query("motif_texts", f"WITH {MOTIFS_SQL} SELECT motif_id, name || '  — ' || trim(summary) || '  Aliases: ' || array_to_string(list_filter(aliases, lambda a: length(a) <= 40), ', ') AS entry, name || '. ' || trim(summary) AS query_text FROM motifs")
def _(spark, d):
    return motifs(spark, d).select("motif_id", T.motif_text(F.col("name"), F.col("summary"), F.col("aliases")).alias("entry"), T.motif_query(F.col("name"), F.col("summary"), F.col("aliases")).alias("query_text"))


@query("motif_groups", "SELECT md5(lower(lang)) AS group_id, min(lang) AS name, count(*)::BIGINT AS members FROM documents GROUP BY 1")
def _(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("motif_id"), F.concat("lang", F.lit(" ; "), "lang").alias("groups"))
    g, m = catalog.groups(rows)
    return g.join(m.groupBy("group_id").agg(F.count("*").alias("members")), "group_id")


@query("stop_list_aliases", f"WITH {MOTIFS_SQL}, a AS (SELECT motif_id, unnest([name] || aliases) AS raw, unnest(range(len(aliases) + 1)) AS nth FROM motifs), n AS (SELECT motif_id, nth, trim(regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g'), '^[,.;:!?\"''()\\[\\]{{}}]+|[,.;:!?\"''()\\[\\]{{}}]+$', '', 'g')) AS alias FROM a) SELECT motif_id, alias, min(nth)::INTEGER AS nth FROM n WHERE alias <> '' AND (nth = 0 OR (length(alias) >= 5 AND alias NOT IN (SELECT DISTINCT lower(name) FROM (SELECT alias AS name FROM n WHERE motif_id % 7 = 0 AND nth = 1)))) GROUP BY motif_id, alias")
def _(spark, d):
    m = motifs(spark, d)
    stop = m.where("motif_id % 7 = 0").select(T.normalize_alias(F.get("aliases", F.lit(0))).alias("word"))
    return gazetteer.admitted_aliases(m, stop.where("word is not null")).select("motif_id", "alias", "nth")


@query("json_extraction", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit("The answer is "), "props", F.lit(" I think")))
    return e.select("event_id", T.extract_json(said, "k int")["k"].alias("k"))


@query("excerpts", r"SELECT doc_id, regexp_replace(regexp_replace('…' || substr(text, 81, greatest(0, least(length(text), 150) - 80)) || CASE WHEN 150 < length(text) THEN '…' ELSE '' END, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS cut FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", T.excerpt(F.col("text"), F.lit(100), F.lit(130), 20, 20).alias("cut"))


@query("edit_expressions", "SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN event_id ELSE 100 + event_id END)::INTEGER AS a, (CASE WHEN event_id % 2 = 0 THEN event_id + 5 ELSE 200 - event_id END)::INTEGER AS b FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    expr = F.when(F.col("event_id") % 2 == 0, F.format_string("%d, %d", "event_id", F.col("event_id") + 5)).otherwise(F.format_string(" +%d,-%d", "event_id", "event_id"))
    p = T.parsed_edit(expr, F.lit(100), F.lit(200))
    return e.select("event_id", p["start"].alias("a"), p["end"].alias("b"))


@query("escaping", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS html_sha, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS xml_sha, sha256(CASE WHEN regexp_matches(html, '[\",\\n]') THEN '\"' || replace(html, '\"', '\"\"') || '\"' ELSE html END) AS csv_sha FROM pages")
def _(spark, d):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", sha(T.escaped_html(h)).alias("html_sha"), sha(T.escaped_xml(h)).alias("xml_sha"), sha(T.escaped_csv(h)).alias("csv_sha"))


@query("pastel_colours", "SELECT DISTINCT source, 'rgba(' || (180 + (h & 31)) || ',' || (170 + ((h >> 5) & 31)) || ',' || (160 + ((h >> 10) & 31)) || ',0.45)' AS rgb FROM (SELECT source, ('0x' || substr(md5(source), 1, 6))::BIGINT AS h FROM documents)")
def _(spark, d):
    return documents(spark, d).select("source").distinct().select("source", T.pastel(F.col("source")).alias("rgb"))


# ---------------------------------------------------------------- gazetteer

W = r"[\p{L}\p{N}_]"
ADMITTED_SQL = MOTIFS_SQL + ", aliases AS (SELECT motif_id, min(nth) AS nth, alias FROM (SELECT motif_id, nth, trim(regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g'), '^[,.;:!?\"''()\\[\\]{}]+|[,.;:!?\"''()\\[\\]{}]+$', '', 'g')) AS alias FROM (SELECT motif_id, unnest([name] || aliases) AS raw, unnest(range(len(aliases) + 1)) AS nth FROM motifs)) WHERE alias <> '' AND (nth = 0 OR length(alias) >= 5) GROUP BY motif_id, alias)"
#: Separators doubled, so that neighbours share none; then each hit is one match.
HITS_SQL = ADMITTED_SQL + rf""", c AS (SELECT doc_id, lower(text) AS l, regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS t FROM documents),
p AS (SELECT *, regexp_extract_all(alias, '[\p{{L}}\p{{N}}_]+') AS words, '(?:^|[^\p{{L}}\p{{N}}_])' || regexp_replace(regexp_replace(alias, '([^\p{{L}}\p{{N}}_ ])', '\\\1\\\1', 'g'), ' +', '(?:[-‐-―]+\\s*|\\s+)', 'g') || CASE WHEN regexp_matches(alias, '(^|\s)\p{{L}}+$') THEN '(?:s|es)?' ELSE '' END || '(?:$|[^\p{{L}}\p{{N}}_])' AS pattern FROM aliases),
cand AS MATERIALIZED (SELECT * FROM c JOIN p ON len(list_filter(words, lambda w: NOT contains(l, w))) = 0),
hits AS (SELECT doc_id, motif_id, alias, nth, len(regexp_extract_all(t, pattern)) AS n FROM cand WHERE regexp_matches(t, pattern))"""


def _hits(spark, d, with_text=False):
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return gazetteer.hits(docs, gazetteer.admitted_aliases(motifs(spark, d)), with_text=with_text)


@query("gazetteer_hits", f"WITH {HITS_SQL} SELECT doc_id, motif_id, alias, n::BIGINT AS hits FROM hits")
def _(spark, d):
    return _hits(spark, d).groupBy(F.col("chunk_id").alias("doc_id"), "motif_id", "alias").agg(F.count("*").alias("hits"))


@query("gazetteer_spans")
def _(spark, d):
    return _hits(spark, d)


@query("gazetteer_seeds")
def _(spark, d):
    """Documents as chunks of their source's work, one after another."""
    found = gazetteer.unblocked(_hits(spark, d, with_text=True)).drop("text")
    places = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("work_id"), (F.col("doc_id") * 1_000_000).alias("char_start"))
    return gazetteer.seeded(found.join(places, "chunk_id"), GazetteerConfig())


@query("top_candidates", f"WITH {HITS_SQL} SELECT motif_id, sum(n)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS docs FROM hits GROUP BY motif_id ORDER BY hits DESC, docs DESC, motif_id LIMIT 15")
def _(spark, d):
    """Normalized documents, all alias hits, counted by motif: the flagship."""
    counted = _hits(spark, d).groupBy("motif_id").agg(F.count("*").alias("hits"), F.countDistinct("chunk_id").alias("docs"))
    return counted.orderBy(F.desc("hits"), F.desc("docs"), "motif_id").limit(15)


ANTI_SQL = rf"WITH t AS (SELECT doc_id, replace(text, ' of ', CASE WHEN doc_id % 2 = 0 THEN ' anti-of ' ELSE ' of ' END) AS text FROM documents) SELECT doc_id, (strpos(text, 'the') - 1)::INTEGER AS s_start FROM t WHERE strpos(text, 'the') > 0 AND NOT regexp_matches(substr(text, greatest(0, strpos(text, 'the') - 61) + 1, least(length(text), strpos(text, 'the') + 62) - greatest(0, strpos(text, 'the') - 61)), '(?i)(^|[^\p{{L}}\p{{N}}_])anti(?:[-‐-―]|\s)+')"


@query("anti_window_block", ANTI_SQL)
def _(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit(" of "), F.lit(" anti-of "))).otherwise(F.col("text"))
    rows = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), text.alias("text"), F.lit(1).alias("motif_id"))
    rows = rows.select("*", (F.instr("text", "the") - 1).alias("start")).where("start >= 0").withColumn("end", F.col("start") + 3)
    return gazetteer.unblocked(rows).select(F.col("chunk_id").alias("doc_id"), F.col("start").alias("s_start"))


@query("anti_phrase_block", "SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'of the') AND doc_id % 2 = 0)")
def _(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 2).alias("motif_id"), F.lit("").alias("_"), "text", F.lit(0).alias("start"), F.lit(1).alias("end"))
    anti = spark.sql("SELECT 0L AS motif_id, 'Of The' AS phrase")
    return gazetteer.unblocked(rows.withColumn("text", F.regexp_replace("text", "(?i)anti", "ant!")), anti).select(F.col("chunk_id").alias("doc_id"))


@query("lexical_mention", rf"SELECT doc_id, (contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'of the') OR regexp_matches(regexp_replace(lower(text), '\s+', ' ', 'g'), '(^|[^\p{{L}}\p{{N}}_])que($|[^\p{{L}}\p{{N}}_])')) AS named FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", T.mentioned(F.array("text"), F.array(F.lit("of the"), F.lit("Que"))).alias("named"))


# ---------------------------------------------------------------- vectors

COS = "round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[]))), 6)"
KNN_SQL = f"knn AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label AS scene_id, {COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, i.vec_id) AS rank FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("scene_id"))


@query("knn_topk", f"WITH {KNN_SQL} SELECT query_id, item_id, similarity, rank::INTEGER AS rank FROM knn WHERE rank <= 8")
def _(spark, d):
    return vectors.nearest(*_vectors(spark, d), 8)


@query("knn_threshold_scene_cap", f"WITH {KNN_SQL}, t AS (SELECT query_id, item_id, scene_id, similarity FROM knn WHERE rank <= 8 AND similarity >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, scene_id ORDER BY similarity DESC, item_id) AS scene_rank FROM t WHERE (query_id + item_id) % 11 <> 0) SELECT query_id, item_id, scene_id, similarity, scene_rank::INTEGER AS scene_rank FROM r WHERE scene_rank <= 2")
def _(spark, d):
    q, i = _vectors(spark, d)
    found = vectors.nearest(q, i, 8, 0.3).join(i.select("item_id", "scene_id"), "item_id")
    there = found.where("(query_id + item_id) % 11 = 0").select("query_id", "item_id")
    return vectors.capped_by_scene(found, there, 2).select("query_id", "item_id", "scene_id", "similarity", "scene_rank")


@query("knn_same_work", f"SELECT label, query_id, item_id, similarity, rank::INTEGER AS rank FROM (SELECT q.label, q.vec_id AS query_id, i.vec_id AS item_id, {COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, i.vec_id) AS rank FROM embeddings q JOIN embeddings i ON q.label = i.label WHERE q.vec_id % 100 = 0) WHERE rank <= 4")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest_within(e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("query_id"), "embedding"), e.select("label", F.col("vec_id").alias("item_id"), "embedding"), "label", 4)


@query("mean_topk_similarity", f"WITH {KNN_SQL} SELECT query_id, round(avg(similarity), 6) AS mean_similarity, count(*)::BIGINT AS n FROM knn WHERE rank <= 3 GROUP BY query_id")
def _(spark, d):
    return vectors.mean_of_nearest(vectors.nearest(*_vectors(spark, d), 3)).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("self_probe", f"WITH {KNN_SQL} SELECT query_id, (query_id = item_id AND 1 - similarity <= 0.001) AS ok FROM knn WHERE rank = 1")
def _(spark, d):
    return vectors.self_probe(vectors.nearest(*_vectors(spark, d), 1))


@query("vector_sanity", "SELECT count(*)::BIGINT AS count, min(len(embedding))::INTEGER AS least_dim, max(len(embedding))::INTEGER AS most_dim, count(DISTINCT len(embedding)) > 1 AS mixed FROM embeddings")
def _(spark, d):
    return vectors.collection_report(table(spark, d, "embeddings"))


@query("vector_upsert", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 1 AND vec_id % 5 <> 1")
def _(spark, d):
    e = F.col("embedding")
    cut = F.when(F.col("vec_id") % 3 == 1, F.slice(e, 1, 8)).when(F.col("vec_id") % 5 == 1, F.slice(e, 1, 0)).otherwise(e)
    return vectors.of_one_size(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), cut.alias("embedding"))).select("id")


@query("unembedded_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "main").otherwise("other").alias("collection"))
    return vectors.unembedded(documents(spark, d).select(F.col("doc_id").alias("chunk_id")), refs, "main").withColumnRenamed("chunk_id", "doc_id")


@query("group_cosine", f"SELECT q.vec_id, {COS} AS similarity FROM embeddings q JOIN embeddings i ON i.vec_id = (q.vec_id + 1) % 100")
def _(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("other"))
    return e.join(other, (F.col("vec_id") + 1) % 100 == F.col("k")).select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("vectors_by_id", "SELECT vec_id AS id, len(embedding)::INTEGER AS dim FROM embeddings WHERE vec_id IN (3, 5, 400)")
def _(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return vectors.by_ids(v, [3, 5, 400]).select("id", F.size("embedding").alias("dim"))


@query("common_cosine", "SELECT vec_id, round(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]))), 6) AS similarity FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(N.cosine_of_common(F.col("embedding"), F.slice("embedding", 1, 32)), 6).alias("similarity"))


# ---------------------------------------------------------------- judge


@query("candidate_union", "SELECT DISTINCT user_id AS scene_id, event_type AS motif_id FROM events WHERE value > 300 OR event_id % 7 = 0")
def _(spark, d):
    f = findings(spark, d)
    return judge.candidate_union(f.where("confidence > 0.6"), f.where("finding_id % 7 = 0"))


HITS_BY_SCENE = "h AS (SELECT user_id AS scene_id, event_id AS chunk_id, round(least(value / 500, 1), 6) AS similarity, row_number() OVER (PARTITION BY user_id ORDER BY round(least(value / 500, 1), 6) DESC, event_id) AS rank FROM events)"


def _scene_hits(spark, d, k=8):
    from pyspark.sql import Window

    w = Window.partitionBy("scene_id").orderBy(F.desc("similarity"), "chunk_id")
    rows = findings(spark, d).select("scene_id", F.col("finding_id").alias("chunk_id"), F.round("confidence", 6).alias("similarity"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("support_fallback", f"WITH {HITS_BY_SCENE}, k AS (SELECT * FROM h WHERE rank <= 3) SELECT scene_id, chunk_id, rank::INTEGER AS rank, similarity AS stage1_score, round((count(*) OVER (PARTITION BY scene_id) - rank + 1) / count(*) OVER (PARTITION BY scene_id), 6) AS stage2_score, 'fallback=knn' AS note FROM k")
def _(spark, d):
    return judge.support(_scene_hits(spark, d), None).withColumn("stage2_score", F.round("stage2_score", 6)).drop("picked")


@query("support_picks", f"WITH {HITS_BY_SCENE}, k AS (SELECT * FROM h WHERE rank <= 8), p AS (SELECT scene_id, chunk_id, row_number() OVER (PARTITION BY scene_id ORDER BY rank DESC) AS place FROM k WHERE rank IN (2, 5) AND scene_id % 2 = 0), u AS (SELECT k.scene_id, k.chunk_id, coalesce(place, rank) AS o FROM k LEFT JOIN p USING (scene_id, chunk_id) WHERE place IS NOT NULL OR k.scene_id NOT IN (SELECT scene_id FROM p)), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY o, chunk_id) AS rank FROM u) SELECT scene_id, chunk_id, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def _(spark, d):
    hits = _scene_hits(spark, d)
    picks = hits.where("rank in (2, 5) and scene_id % 2 = 0").groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("rank"), "chunk_id"))).alias("x")).select("scene_id", F.concat(F.col("x.chunk_id"), F.array(F.lit(-5).cast("long"))).alias("support_ids"))
    return judge.support(hits, picks).select("scene_id", "chunk_id", "rank")


@query("prior_weights", "SELECT DISTINCT doc_id AS scene_id, (doc_id % 5)::INTEGER AS motif_id, (contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the'))::INTEGER AS lex_ok, round((doc_id % 100) / 100.0, 2)::DOUBLE AS sem_sim, CASE WHEN contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the') OR (doc_id % 100) / 100.0 >= 0.36 THEN 1.0 ELSE 0.55 END::DOUBLE AS weight FROM documents")
def _(spark, d):
    docs = documents(spark, d)
    c = docs.select(F.col("doc_id").alias("scene_id"), (F.col("doc_id") % 5).cast("int").alias("motif_id"))
    phrases = spark.range(5).select(F.col("id").cast("int").alias("motif_id"), F.array(F.lit("of the")).alias("phrases"))
    sims = c.withColumn("sem_sim", F.round((F.col("scene_id") % 100) / 100, 2))
    return judge.sanity(c, docs.select(F.col("doc_id").alias("scene_id"), F.array("text").alias("texts")), phrases, sims)


GATE_SQL = FINDINGS_SQL + ", w AS (SELECT *, CASE WHEN finding_id % 3 = 0 THEN 0.55 ELSE 1.0 END AS weight, CASE motif_id WHEN 'click' THEN 0.5 END AS threshold FROM findings), g AS (SELECT *, greatest(0, least(1, confidence * weight)) AS adj, coalesce(threshold, 0.25) AS threshold_used FROM w)"


def _gated(spark, d):
    f = findings(spark, d).withColumn("scene_id", F.col("finding_id")).withColumn("rationale", F.lit("said"))
    w = f.where("finding_id % 3 = 0").select("scene_id", "motif_id", F.lit(0.55).alias("weight"))
    t = spark.sql("SELECT 'click' AS motif_id, 0.5D AS threshold")
    return judge.gated(f, w, t)


@query("threshold_gate", f"WITH {GATE_SQL} SELECT finding_id, round(adj, 6) AS confidence, round(weight, 2)::DOUBLE AS weight, round(threshold_used, 2)::DOUBLE AS threshold_used FROM g WHERE adj >= threshold_used")
def _(spark, d):
    return _gated(spark, d).select("finding_id", F.round("confidence", 6).alias("confidence"), "weight", "threshold_used")


@query("rationale_notes", f"WITH {GATE_SQL} SELECT finding_id, CASE WHEN weight <> 1 THEN 'said [prior=0.55, raw=' || round(confidence::DECIMAL(18, 9), 2)::DECIMAL(9, 2) || ', adj=' || round(adj::DECIMAL(18, 9), 2)::DECIMAL(9, 2) || ']' ELSE 'said' END AS rationale FROM g WHERE adj >= threshold_used")
def _(spark, d):
    return _gated(spark, d).select("finding_id", "rationale")


@query("judge_findings", f"WITH {FINDINGS_SQL}, j AS (SELECT *, greatest(0, least(s, 800)) AS a, greatest(0, least(e, 800)) AS b FROM findings WHERE confidence >= 0.25), n AS (SELECT work_id, motif_id, least(a, b)::INTEGER AS evidence_start, greatest(a, b)::INTEGER AS evidence_end, max(confidence) AS confidence FROM j GROUP BY ALL) SELECT work_id, motif_id, evidence_start, evidence_end, round(confidence, 6) AS confidence FROM n")
def _(spark, d):
    f = findings(spark, d)
    scenes = f.select("scene_id", "work_id").distinct().select("scene_id", "work_id", F.lit(0).alias("char_start"), F.lit(500).alias("char_end"))
    w = spark.range(10).select(F.col("id").alias("work_id"), F.lit(800).alias("char_count"))
    old = f.limit(0).select("work_id", "motif_id", F.lit(0).alias("evidence_start"), F.lit(0).alias("evidence_end"), "confidence", "scene_id")
    weights = f.limit(0).select("scene_id", "motif_id", F.lit(1.0).alias("weight"))
    items = f.select("scene_id", "motif_id", "confidence", F.lit("r").alias("rationale"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    out = judge.judge(old, items, judge.candidate_union(f), weights, None, scenes, w, "run-1", JudgeConfig())
    return out.select("work_id", "motif_id", "evidence_start", "evidence_end", F.round("confidence", 6).alias("confidence"))


PROMPT_SQL = HITS_SQL + r""", q AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), cut AS (SELECT doc_id, CASE WHEN length(t) > 480 THEN substr(t, 1, 479) || '…' ELSE t END AS t FROM q),
defs AS (SELECT doc_id, string_agg('- ' || motif_id || ' | ' || name || ' | PRIOR=0.55 | ' || summary, chr(10) ORDER BY '- ' || motif_id || ' | ' || name) AS x FROM (SELECT DISTINCT doc_id, motif_id FROM hits) JOIN motifs USING (motif_id) GROUP BY doc_id)"""


@query("judge_prompts", f"WITH {PROMPT_SQL} SELECT d.doc_id AS scene_id, sha256(concat_ws(chr(10) || chr(10), 'SCENE', substr(d.text, 1, 2400), 'SUPPORT', '[1] ' || a.t || coalesce(chr(10) || '[2] ' || b.t, ''), 'MOTIFS', defs.x)) AS prompt_sha FROM defs JOIN documents d USING (doc_id) JOIN cut a USING (doc_id) LEFT JOIN cut b ON b.doc_id = d.doc_id - 1")
def _(spark, d):
    """Documents as scenes, the motifs that are named in them as candidates, and each scene and the one before it as support."""
    c = _hits(spark, d).select(F.col("chunk_id").alias("scene_id"), F.col("motif_id").cast("string").alias("motif_id")).distinct()
    texts = documents(spark, d).select(F.col("doc_id").alias("scene_id"), "text")
    defs = motifs(spark, d).select(F.col("motif_id").cast("string"), "name", "summary")
    supports = texts.select("scene_id", F.lit(1).alias("rank"), "text").unionByName(texts.select((F.col("scene_id") + 1).alias("scene_id"), F.lit(2).alias("rank"), "text"))
    prompts = judge.prompts(c, texts, defs, supports, c.withColumn("weight", F.lit(0.55)))
    return prompts.select("scene_id", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha"))


@query("catalog_shortlist", f"SELECT scene_id, motif_id, similarity, rank::INTEGER AS rank FROM (SELECT i.vec_id AS scene_id, q.vec_id AS motif_id, {COS} AS similarity, row_number() OVER (PARTITION BY i.vec_id ORDER BY {COS} DESC, q.vec_id) AS rank FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0) WHERE rank <= 12")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.shortlist(e.select(F.col("vec_id").alias("scene_id"), "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("motif_id"), "embedding"), JudgeConfig().shortlist)


@query("knn_by_work", f"SELECT query_id, work_id, item_id, similarity, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, i.label AS work_id, i.vec_id AS item_id, {COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id, i.label ORDER BY {COS} DESC, i.vec_id) AS rank FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0) WHERE rank <= 8")
def _(spark, d):
    q, i = _vectors(spark, d)
    return vectors.nearest(q, i.withColumnRenamed("scene_id", "work_id"), 8, by="work_id")


# ---------------------------------------------------------------- writes


@query("insert_or_ignore", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey // 2 AS k, o_custkey AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_orderkey) = 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def _(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    new = o.select(F.expr("o_orderkey div 2").alias("k"), F.col("o_custkey").alias("v"), F.col("o_orderkey").alias("seq"))
    return tables.insert_or_ignore(old, new, ["k"], ["seq"])


@query("insert_or_replace", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey // 2 AS k, o_custkey AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_orderkey DESC) = 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def _(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    new = o.select(F.expr("o_orderkey div 2").alias("k"), F.col("o_custkey").alias("v"), F.col("o_orderkey").alias("seq"))
    return tables.insert_or_replace(old, new, ["k"], [F.desc("seq")])


@query("upsert_keep_created", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, coalesce(a.c, b.c) AS created_at FROM (SELECT c_custkey AS k, c_nationkey AS v, 1 AS c FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, c_nationkey + 100 AS v, 2 AS c FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
def _(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"), F.lit(1).alias("created_at"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + 100).alias("v"), F.lit(2).alias("created_at"))
    return tables.upsert(old, new, ["k"])


@query("update_and_delete", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    kind = dict(c.dtypes)["v"]
    rows = tables.update(c, c.where("k % 4 = 0").select("k", F.lit(-1).cast(kind).alias("v")), ["k"])
    return tables.delete(rows, c.where("k % 5 = 0"), ["k"])


@query("stamped_calibration", f"WITH {FINDINGS_SQL}, t AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN finding_id % 6 = 0 THEN 'v0' END AS v FROM findings) SELECT finding_id, CASE WHEN work_id = 3 AND day >= '2024-01-15' AND v IS NULL THEN 'v1' ELSE v END AS calibration_version, CASE WHEN work_id = 3 AND day >= '2024-01-15' AND v IS NULL THEN 0.62 ELSE 0.25 END::DOUBLE AS threshold_used FROM t")
def _(spark, d):
    f = findings(spark, d).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd")).withColumn("threshold_used", F.lit(0.25))
    f = f.withColumn("calibration_version", F.when(F.col("finding_id") % 6 == 0, "v0"))
    return calibrate.stamped(f, "v1", 0.62, 3, "2024-01-15").select("finding_id", "calibration_version", "threshold_used")


# ---------------------------------------------------------------- spans


@query("span_containment", f"WITH {FINDINGS_SQL}, c AS (SELECT work_id, k AS chunk, k * 400 AS char_start, k * 400 + 500 AS char_end FROM (SELECT unnest(range(10)) AS work_id), (SELECT unnest(range(3)) AS k)) SELECT finding_id, chunk FROM findings f JOIN c ON f.work_id = c.work_id AND s >= char_start AND e <= char_end")
def _(spark, d):
    c = spark.range(30).select(F.expr("id div 3").alias("work_id"), (F.col("id") % 3).alias("chunk"), ((F.col("id") % 3) * 400).alias("char_start"), ((F.col("id") % 3) * 400 + 500).alias("char_end"))
    return spans.inside(findings(spark, d), c, "work_id", 256).select("finding_id", "chunk")


SENT_LIST_SQL = r"p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]+(?:\s+|$)|\n{2,})', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents), q AS (SELECT doc_id, text, unnest(p) AS s, unnest(range(len(p))) AS i FROM p), o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q), f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, (a + length(s) - length(regexp_replace(s, '^\s+', '')))::INTEGER AS x, (a + length(regexp_replace(s, '\s+$', '')))::INTEGER AS y FROM o WHERE regexp_replace(s, '\s+', '', 'g') <> ''), sents AS (SELECT * FROM f UNION ALL SELECT doc_id, text, 0, 0, length(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f))"


@query("overlapping_sentence", f"WITH {SENT_LIST_SQL} SELECT doc_id, coalesce(min(i) FILTER (NOT (y <= 50 OR x >= 90)), 0)::INTEGER AS i FROM sents GROUP BY doc_id")
def _(spark, d):
    s = segment.sentences(F.col("text"))
    return documents(spark, d).select("doc_id", spans.first_overlapping(s, F.lit(50), F.lit(90)).cast("int").alias("i"))


@query("nearest_sentence", f"WITH {SENT_LIST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN x <= 70 AND 70 < y THEN 0 ELSE 1 END, CASE WHEN x <= 70 AND 70 < y THEN 0 ELSE abs((x + y) // 2 - 70) END, i) AS n FROM sents) SELECT doc_id, x AS s_start, y AS s_end FROM r WHERE n = 1")
def _(spark, d):
    s = spans.sentence_of(segment.sentences(F.col("text")), F.lit(50), F.lit(90))
    return documents(spark, d).select("doc_id", s["start"].alias("s_start"), s["end"].alias("s_end"))


@query("span_snap", r"""WITH p AS (SELECT doc_id, length(text) AS n, string_split(regexp_replace(text, '([.!?]"?\s)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents), q AS (SELECT doc_id, n, unnest(p) AS s, unnest(range(len(p))) AS i FROM p), c AS (SELECT doc_id, n, i, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS c, length(s) AS l FROM q), b AS (SELECT doc_id, n, coalesce(max(c) FILTER (i % 2 = 1 AND c <= least(150, n)), 0) AS lo, coalesce(min(c) FILTER (i % 2 = 1 AND c - l >= least(200, n)), n) AS hi, least(280, n) AS size FROM c GROUP BY doc_id, n) SELECT doc_id, (CASE WHEN hi - lo > size THEN greatest(0, least((least(150, n) + least(200, n)) // 2 - size // 2, n - size)) ELSE lo END)::INTEGER AS s_start, (CASE WHEN hi - lo > size THEN greatest(0, least((least(150, n) + least(200, n)) // 2 - size // 2, n - size)) + size ELSE hi END)::INTEGER AS s_end FROM b""")
def _(spark, d):
    s = spans.snapped(F.col("text"), F.lit(150), F.lit(200))
    return documents(spark, d).select("doc_id", s["start"].alias("s_start"), s["end"].alias("s_end"))


WINDOWS_SQL = SENT_LIST_SQL + """, c AS (SELECT doc_id, length(text) AS n, coalesce(min(i) FILTER (NOT (y <= 50 OR x >= 90)), 0) AS idx, max(i) AS most FROM sents GROUP BY doc_id, text),
k AS (SELECT *, greatest(0, least(most, idx + unnest(range(-2, 3)))) AS other FROM c),
ab AS (SELECT k.doc_id, k.n, least(h.x, o.x) AS a, greatest(h.y, o.y) AS b FROM k JOIN sents h ON h.doc_id = k.doc_id AND h.i = k.idx JOIN sents o ON o.doc_id = k.doc_id AND o.i = k.other UNION ALL SELECT doc_id, n, 50, 90 FROM c),
z AS (SELECT *, greatest(0, least(70 - 140, n - 280)) AS start FROM ab)"""


@query("candidate_windows", f"WITH {WINDOWS_SQL} SELECT DISTINCT doc_id, (CASE WHEN b - a > 280 THEN start ELSE a END)::INTEGER AS s_start, (CASE WHEN b - a > 280 THEN least(n, start + 280) ELSE b END)::INTEGER AS s_end FROM z")
def _(spark, d):
    w = spans.candidate_windows(segment.sentences(F.col("text")), F.lit(50), F.lit(90), F.length("text"))
    rows = documents(spark, d).select("doc_id", F.explode(w).alias("w"))
    return rows.select("doc_id", F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"))


@query("verified_spans", f"WITH {FINDINGS_SQL}, r AS (SELECT finding_id // 5 AS g, s AS a, e AS b, finding_id % 5 = 0 AS o, round(0.7 * confidence + 0.3 * (1 - confidence), 6) AS score FROM findings), m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, o::INTEGER DESC, a, b) AS n FROM r), x AS (SELECT b.g, b.a, b.b, b.score, o.a AS oa, o.b AS ob, coalesce(o.score, 0) AS os FROM (SELECT * FROM m WHERE n = 1) b LEFT JOIN (SELECT * FROM r WHERE o) o USING (g)) SELECT g AS finding_id, score AS verifier_score, CASE WHEN score < 0.32 THEN 'low_sim' ELSE 'ok' END AS verifier_flag, (coalesce(NOT (a = oa AND b = ob), true) AND (score >= os + 0.05 OR (os < 0.32 AND score >= 0.32))) AS adopted FROM x")
def _(spark, d):
    f = findings(spark, d)
    rows = f.select(F.expr("finding_id div 5").alias("finding_id"), "start", "end", (F.col("finding_id") % 5 == 0).alias("is_original"), F.lit("plain").alias("text"), F.col("confidence").alias("motif_similarity"), (1 - F.col("confidence")).alias("scene_similarity"))
    return spans.verified(rows).drop("start", "end")


FLAG_SQL = r"""WITH t AS (SELECT doc_id, substr(text, greatest(0, 60 - 40) + 1, greatest(0, least(length(text), 90 + 40) - 20)) AS w FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 40) || ' never ' || substr(text, 41) WHEN 1 THEN substr(text, 1, 40) || ' a parody of anti-of ' || substr(text, 41) WHEN 2 THEN substr(text, 1, 40) || ' cliché ' || substr(text, 41) ELSE text END AS text FROM documents)), f AS (SELECT doc_id, regexp_matches(w, '(?i)(^|[^\p{L}\p{N}_])(no|never|without|lack(?:ing)?(?:\s+of)?|absence(?:\s+of)?|free\s+of)($|[^\p{L}\p{N}_])') AS neg, regexp_matches(w, '(?i)(^|[^\p{L}\p{N}_])(parody|satire|meta|lampshad\p{L}*|deconstruct\p{L}*|clich(?:e|é)s?)($|[^\p{L}\p{N}_])') AS meta, regexp_matches(w, '(?i)(^|[^\p{L}\p{N}_])anti(?:[-‐-―]|\s)+') AS "anti" FROM t) SELECT doc_id, neg, meta, "anti", CASE WHEN neg AND "anti" THEN 'negation_anti' WHEN neg THEN 'negation_cue' WHEN "anti" THEN 'anti_alias' WHEN meta THEN 'meta_cue' END AS verifier_flag, round(0.8 * CASE WHEN neg THEN 0.6 ELSE 1 END * CASE WHEN meta THEN 0.75 ELSE 1 END * CASE WHEN "anti" THEN 0.5 ELSE 1 END, 6)::DOUBLE AS verified_confidence FROM f"""


@query("cue_flags", FLAG_SQL)
def _(spark, d):
    t = F.col("text")
    put = lambda s: F.concat(F.substring(t, 1, 40), F.lit(s), t.substr(F.lit(41), F.length(t)))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, put(" never ")).when(k == 1, put(" a parody of anti-of ")).when(k == 2, put(" cliché ")).otherwise(t)
    rows = documents(spark, d).select("doc_id", text.alias("text"), F.lit(60).alias("start"), F.lit(90).alias("end"), F.lit(0.8).alias("confidence"))
    out = spans.cue_flags(rows)
    return out.select("doc_id", "neg", "meta", "anti", "verifier_flag", F.round("verified_confidence", 6).alias("verified_confidence"))


@query("negation_words", r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(no|not|never|without|hardly|rarely|seldom|none)($|[^\p{L}\p{N}_])') AS negated FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.col("text").rlike(T.NEGATION).alias("negated"))


@query("span_overlap", f"WITH {FINDINGS_SQL} SELECT finding_id, round(CASE WHEN least(e, 500) > greatest(s, 300) THEN (least(e, 500) - greatest(s, 300)) / (greatest(e, 500) - least(s, 300)) ELSE 0 END, 6)::DOUBLE AS overlap FROM findings")
def _(spark, d):
    return findings(spark, d).select("finding_id", F.round(N.iou(F.col("start"), F.col("end"), F.lit(300), F.lit(500)), 6).alias("overlap"))


@query("clipped_spans", f"WITH {FINDINGS_SQL} SELECT finding_id, least(greatest(0, least(e, 600)), greatest(0, least(s, 600)))::BIGINT AS a, greatest(greatest(0, least(e, 600)), greatest(0, least(s, 600)))::BIGINT AS b FROM findings")
def _(spark, d):
    a, b = N.clipped(F.col("end"), F.col("start"), F.lit(600))
    return findings(spark, d).select("finding_id", a.cast("long").alias("a"), b.cast("long").alias("b"))


@query("one_to_one_matches")
def _(spark, d):
    """The findings of even number are the truth, all others the predictions."""
    f = findings(spark, d)
    truth = f.where("finding_id % 2 = 0").select("scene_id", "motif_id", F.col("finding_id").alias("truth_id"), "start", "end")
    predicted = f.where("finding_id % 2 = 1").select("scene_id", "motif_id", F.col("finding_id").alias("predicted_id"), "start", "end")
    return spans.matched_one_to_one(predicted, truth, ["scene_id", "motif_id"], 0.1)


# ---------------------------------------------------------------- review


@query("latest_decision", f"WITH {LATEST_SQL} SELECT id, finding_id, decision FROM latest")
def _(spark, d):
    return review.latest_decisions(log(spark, d)).select("id", "finding_id", "decision")


@query("latest_decision_ties", f"WITH {LOG_SQL} SELECT log.id, log.finding_id FROM log JOIN (SELECT finding_id, max(created_at) AS m FROM log GROUP BY 1) x ON log.finding_id = x.finding_id AND log.created_at = x.m")
def _(spark, d):
    return review.latest_decisions(log(spark, d), ties=True).select("id", "finding_id")


@query("unreviewed_queue", f"WITH {LOG_SQL}, {FINDINGS_SQL} SELECT finding_id, round(confidence, 6) AS confidence FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM log) AND motif_id = 'click' AND confidence BETWEEN 0.2 AND 0.9 AND finding_id <> 3 ORDER BY abs(confidence - 0.5), created_at DESC, finding_id LIMIT 25")
def _(spark, d):
    q = review.queue(findings(spark, d), log(spark, d), "uncertain", 25, "click", 0.2, 0.9, 3)
    return q.select("finding_id", F.round("confidence", 6).alias("confidence"))


@query("newest_findings", f"WITH {LOG_SQL}, {FINDINGS_SQL} SELECT finding_id FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM log) ORDER BY created_at DESC, finding_id LIMIT 30")
def _(spark, d):
    return review.queue(findings(spark, d), log(spark, d), "newest", 30).select("finding_id")


@query("scene_counts", f"WITH {LATEST_SQL}, {FINDINGS_SQL} SELECT scene_id, count(*)::BIGINT AS findings, count(*) FILTER (decision = 'accept')::BIGINT AS accepted, count(*) FILTER (decision = 'reject')::BIGINT AS rejected, count(decision)::BIGINT AS reviewed, round(count(decision) / count(*), 6)::DOUBLE AS reviewed_share FROM findings LEFT JOIN latest USING (finding_id) GROUP BY scene_id")
def _(spark, d):
    return review.scene_counts(findings(spark, d), review.latest_decisions(log(spark, d))).withColumn("reviewed_share", F.round("reviewed_share", 6))


@query("work_counts", f"WITH {FINDINGS_SQL} SELECT w.work_id, count(DISTINCT scene_id)::BIGINT AS scenes, count(finding_id)::BIGINT AS findings FROM (SELECT unnest(range(12)) AS work_id) w LEFT JOIN findings f ON w.work_id = f.work_id GROUP BY w.work_id")
def _(spark, d):
    f = findings(spark, d)
    return review.work_counts(spark.range(12).withColumnRenamed("id", "work_id"), f.select("work_id", "scene_id").distinct(), f)


@query("motif_bias", f"WITH {LATEST_SQL}, {FINDINGS_SQL} SELECT motif_id, count(*) FILTER (decision = 'accept')::BIGINT AS accepted, count(*) FILTER (decision = 'reject')::BIGINT AS rejected, round(0.8 + 0.4 * (count(*) FILTER (decision = 'accept') + 1) / (count(*) + 2), 6)::DOUBLE AS bias FROM latest JOIN findings USING (finding_id) WHERE decision IN ('accept', 'reject') GROUP BY motif_id")
def _(spark, d):
    return review.motif_bias(findings(spark, d), review.latest_decisions(log(spark, d))).withColumn("bias", F.round("bias", 6))


@query("current_findings", f"WITH {LOG_SQL}, {FINDINGS_SQL}, x AS (SELECT finding_id, id FROM log WHERE decision = 'edit' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) = 1), y AS (SELECT finding_id, decision FROM log QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) = 1) SELECT f.finding_id, coalesce(x.id, s)::BIGINT AS s_start, coalesce(x.id + 9, e)::BIGINT AS s_end, decision FROM findings f LEFT JOIN x USING (finding_id) LEFT JOIN y USING (finding_id)")
def _(spark, d):
    entries = log(spark, d).select("*", F.col("id").alias("corrected_start"), (F.col("id") + 9).alias("corrected_end"), F.lit(None).cast("string").alias("corrected_motif_id"))
    return review.current_findings(findings(spark, d), entries).select("finding_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "decision")


@query("validation", f"WITH {FINDINGS_SQL} SELECT (SELECT count(*) FROM findings WHERE e <= s OR s < 0 OR s < 0 OR e > 500) AS bad_spans, (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)) AS orphans, (SELECT count(*) FROM findings WHERE NOT (confidence BETWEEN 0 AND 1)) AS bad_weights, (SELECT count(*) FROM (SELECT work_id, motif_id, s, e FROM findings GROUP BY ALL HAVING count(*) > 1)) AS duplicates")
def _(spark, d):
    f = findings(spark, d).withColumn("low", F.lit(0)).withColumn("high", F.lit(500))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(validate.bad_spans(f, low="low", high="high"), "bad_spans"), n(validate.orphans(table(spark, d, "events"), table(spark, d, "customer"), "user_id", "c_custkey"), "orphans"), n(validate.bad_weights(f, "confidence"), "bad_weights"), n(validate.duplicate_keys(f, ["work_id", "motif_id", "start", "end"]), "duplicates")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


# ---------------------------------------------------------------- calibration

POINTS_SQL = FINDINGS_SQL + ", points AS (SELECT motif_id, confidence, CASE WHEN (finding_id * 37) % 100 < confidence * 100 THEN 1 ELSE 0 END AS y FROM findings)"


def points(spark, d):
    f = findings(spark, d)
    return f.select("motif_id", "confidence", F.when((F.col("finding_id") * 37) % 100 < F.col("confidence") * 100, 1).otherwise(0).alias("y"))


GRID = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(calibrate.thresholds()))
SWEEP_SQL = POINTS_SQL + f", grid(i, t) AS (VALUES {GRID}), counts AS (SELECT i, t, count(*) FILTER (confidence >= t AND y = 1) AS tp, count(*) FILTER (confidence >= t AND y = 0) AS fp, count(*) FILTER (confidence < t AND y = 0) AS tn, count(*) FILTER (confidence < t AND y = 1) AS fn FROM points, grid GROUP BY i, t), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM counts), swept AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)"


@query("threshold_sweep", f"WITH {SWEEP_SQL} SELECT i::INTEGER AS i, round(t, 4) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, round((tp + tn) / (tp + fp + tn + fn), 6)::DOUBLE AS accuracy, round((tp + fp) / (tp + fp + tn + fn), 6)::DOUBLE AS positive_rate FROM swept")
def _(spark, d):
    s = calibrate.sweep(points(spark, d)).drop("t")
    return s.select("i", "threshold", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "positive_rate")))


for _name, _order in (("f1", "f1 DESC, p DESC, t"), ("f1@precision", "(p >= 0.7) DESC, CASE WHEN p >= 0.7 THEN f1 ELSE p END DESC, CASE WHEN p >= 0.7 THEN r ELSE f1 END DESC, t"), ("precision@recall", "(r >= 0.1) DESC, CASE WHEN r >= 0.1 THEN p ELSE r END DESC, CASE WHEN r >= 0.1 THEN f1 ELSE p END DESC, t")):

    @query(f"choose_{_name.replace('@', '_at_')}", f"WITH {SWEEP_SQL} SELECT round(t, 4) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM swept ORDER BY {_order} LIMIT 1")
    def _(spark, d, objective=_name):
        return calibrate.choose(calibrate.sweep(points(spark, d)), objective).select("threshold", "tp", "fp")


@query("pick_smallest_best_f1", f"WITH {POINTS_SQL}, g AS (SELECT unnest(range(101)) / 100 AS t), c AS (SELECT t, count(*) FILTER (confidence >= t AND y = 1) AS tp, count(*) FILTER (confidence >= t) AS pos, (SELECT sum(y) FROM points) AS allp FROM points, g GROUP BY t) SELECT t::DOUBLE AS threshold, tp::BIGINT AS tp FROM c ORDER BY CASE WHEN tp > 0 THEN round(2 * (tp / pos) * (tp / allp) / (tp / pos + tp / allp), 9) ELSE 0 END DESC, t LIMIT 1")
def _(spark, d):
    s = calibrate.sweep(points(spark, d), calibrate.thresholds(0.01, False)).withColumn("f1", F.round("f1", 9)).withColumn("precision", F.lit(0.0))
    return calibrate.choose(s, "f1").select("threshold", "tp")


EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in [*calibrate.edges(10), 1.0]) + "]"
BINS_SQL = POINTS_SQL + f", b AS (SELECT (len(list_filter({EDGES}[1:10], lambda e: confidence >= e)) - 1)::INTEGER AS bin, count(*) AS n, avg(confidence) AS c, avg(y) AS a FROM points WHERE confidence BETWEEN 0 AND 1 GROUP BY 1)"
PRESENT_SQL = POINTS_SQL + ", b AS (SELECT least(9, floor(greatest(0, least(1, confidence)) * 10))::INTEGER AS bin, count(*) AS n, avg(y) AS a FROM points GROUP BY 1)"


@query("reliability_bins", f"WITH {BINS_SQL} SELECT k::INTEGER AS bin, {EDGES}[k + 1] AS low, {EDGES}[k + 2] AS high, coalesce(n, 0)::BIGINT AS n, round(coalesce(c, 0), 6) AS mean_confidence, round(coalesce(a, 0), 6) AS accept_rate FROM (SELECT unnest(range(10)) AS k) LEFT JOIN b ON k = bin")
def _(spark, d):
    return calibrate.reliability(points(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("accept_rate", F.round("accept_rate", 6))


@query("reliability_present", f"WITH {PRESENT_SQL} SELECT bin, ((bin + 0.5) / 10)::DOUBLE AS middle, n::BIGINT AS n, round(a, 6) AS accept_rate FROM b")
def _(spark, d):
    return calibrate.reliability_present(points(spark, d)).withColumn("accept_rate", F.round("accept_rate", 6)).withColumn("bin", F.col("bin").cast("int"))


@query("calibration_error", f"WITH {BINS_SQL} SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b")
def _(spark, d):
    return calibrate.calibration_error(calibrate.reliability(points(spark, d))).withColumn("ece", F.round("ece", 6))


@query("motif_thresholds", f"WITH {POINTS_SQL}, g AS (SELECT motif_id, count(*) AS samples, sum(y) AS pos FROM points GROUP BY 1 HAVING count(*) >= 8), p AS (SELECT motif_id, confidence AS s, y FROM points), t AS (SELECT motif_id, round(s, 3) AS t FROM p UNION SELECT motif_id, k * 0.01::DOUBLE FROM g, (SELECT unnest(range(101)) AS k)), c AS (SELECT t.motif_id, t.t, count(*) FILTER (s >= t AND y = 1) AS tp, count(*) FILTER (s >= t) AS hit FROM t JOIN p USING (motif_id) GROUP BY ALL), m AS (SELECT c.*, pos, CASE WHEN hit > 0 THEN tp / hit ELSE 0 END AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re FROM c JOIN g USING (motif_id)), b AS (SELECT motif_id, t FROM m WHERE pr >= 0.6 AND tp > 0 QUALIFY row_number() OVER (PARTITION BY motif_id ORDER BY round(2 * pr * re / (pr + re), 9) DESC, t) = 1) SELECT motif_id, coalesce(t, 0.5)::DOUBLE AS threshold, samples::BIGINT AS samples, pos::BIGINT AS positives, (samples - pos)::BIGINT AS negatives FROM g LEFT JOIN b USING (motif_id)")
def _(spark, d):
    return calibrate.motif_thresholds(points(spark, d), CalibrationConfig(min_precision=0.6))


REVIEW_SQL = LATEST_SQL + ", " + FINDINGS_SQL + ", points AS (SELECT CASE WHEN id % 4 = 0 THEN 'corrected' ELSE motif_id END AS motif_id, confidence AS s, CASE decision WHEN 'accept' THEN 1 ELSE 0 END AS y FROM latest JOIN findings USING (finding_id) WHERE decision IN ('accept', 'reject'))"


@query("review_thresholds", f"WITH {REVIEW_SQL}, g AS (SELECT motif_id, count(*) AS samples, sum(y) AS pos FROM points GROUP BY 1 HAVING count(*) >= 6), c AS (SELECT t.motif_id, t.s AS t, count(*) FILTER (p.s >= t.s AND y = 1) AS tp, count(*) FILTER (p.s >= t.s AND y = 0) AS fp FROM (SELECT DISTINCT motif_id, s FROM points) t JOIN points p USING (motif_id) GROUP BY ALL), m AS (SELECT c.*, pos, samples, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re FROM c JOIN g USING (motif_id)), f AS (SELECT *, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1 FROM m) SELECT motif_id, t AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn, round(f1, 6)::DOUBLE AS f1, samples::BIGINT AS n FROM f QUALIFY row_number() OVER (PARTITION BY motif_id ORDER BY f1 DESC, t) = 1")
def _(spark, d):
    """Decisions of ids divisible by 4 also correct the motif."""
    latest = review.latest_decisions(log(spark, d)).withColumn("corrected_motif_id", F.when(F.col("id") % 4 == 0, "corrected"))
    return calibrate.review_thresholds(calibrate.reviewed_points(findings(spark, d), latest)).select("motif_id", "threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "n")


# ---------------------------------------------------------------- analytics


@query("top_motifs", f"WITH {FINDINGS_SQL} SELECT motif_id, count(DISTINCT scene_id)::BIGINT AS scenes, count(*)::BIGINT AS hits, upper(motif_id) AS name FROM findings GROUP BY motif_id ORDER BY scenes DESC, hits DESC, lower(motif_id) LIMIT 4")
def _(spark, d):
    f = findings(spark, d)
    return analytics.top_motifs(f, f.select("motif_id", F.upper("motif_id").alias("name")).distinct(), 4)


@query("heatmap_maximum", f"WITH {FINDINGS_SQL} SELECT scene_id, motif_id, round(max(confidence), 6) AS confidence FROM findings GROUP BY ALL")
def _(spark, d):
    return analytics.scene_maximum(findings(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("heatmap_pivot", f"WITH {FINDINGS_SQL} SELECT scene_id, round(coalesce(max(confidence) FILTER (motif_id = 'click'), 0), 6) AS click, round(coalesce(max(confidence) FILTER (motif_id = 'view'), 0), 6) AS view, round(coalesce(max(confidence) FILTER (motif_id = 'none'), 0), 6) AS none FROM findings GROUP BY scene_id")
def _(spark, d):
    h = analytics.heatmap(findings(spark, d), ["click", "view", "none"])
    return h.select("scene_id", *(F.round(c, 6).alias(c) for c in ("click", "view", "none")))


PAIRS_SQL = FINDINGS_SQL + ", sm AS (SELECT DISTINCT scene_id, motif_id FROM findings WHERE confidence >= 0.25)"


def _pairs(spark, d):
    return analytics.scene_motifs(findings(spark, d))


EDGES_SQL = PAIRS_SQL + ", edges AS (SELECT a.motif_id AS src, b.motif_id AS dst, count(*) AS weight FROM sm a JOIN sm b ON a.scene_id = b.scene_id AND a.motif_id < b.motif_id GROUP BY ALL)"


@query("cooccurrence_edges", f"WITH {EDGES_SQL} SELECT src, dst, weight::BIGINT AS weight FROM edges")
def _(spark, d):
    return analytics.cooccurrence(_pairs(spark, d))


@query("cooccurrence_nodes", f"WITH {PAIRS_SQL} SELECT motif_id, count(*)::BIGINT AS scenes FROM sm GROUP BY motif_id")
def _(spark, d):
    return analytics.node_counts(_pairs(spark, d))


@query("strongest_edges", f"WITH {EDGES_SQL}, n AS (SELECT motif_id FROM sm GROUP BY 1 ORDER BY count(*) DESC, motif_id LIMIT 3), e AS (SELECT * FROM edges WHERE src IN (SELECT * FROM n) AND dst IN (SELECT * FROM n)) SELECT src, dst, weight::BIGINT AS weight, round(CASE WHEN max(weight) OVER () > min(weight) OVER () THEN 0.2 + 0.8 * (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) ELSE 1 END, 6)::DOUBLE AS alpha FROM e")
def _(spark, d):
    p = _pairs(spark, d)
    return analytics.strongest(analytics.cooccurrence(p), analytics.node_counts(p), 3).withColumn("alpha", F.round("alpha", 6))


@query("accepted_scene_motifs", f"WITH {LATEST_SQL}, {FINDINGS_SQL} SELECT DISTINCT scene_id, motif_id FROM findings WHERE confidence >= 0.25 AND finding_id IN (SELECT finding_id FROM latest WHERE decision = 'accept')")
def _(spark, d):
    return analytics.scene_motifs(findings(spark, d), 0.25, review.latest_decisions(log(spark, d)))


GRAPHML_SQL = EDGES_SQL + """, n AS (SELECT motif_id, count(*) AS scenes FROM sm GROUP BY motif_id) SELECT 0 AS part, (row_number() OVER (ORDER BY scenes DESC, motif_id) - 1)::INTEGER AS number, '<node id="' || motif_id || '"><data key="d0">' || upper(motif_id) || '</data><data key="d1">' || scenes || '</data></node>' AS line FROM n
UNION ALL SELECT 1, number::INTEGER, '<edge id="e' || number || '" source="' || src || '" target="' || dst || '"><data key="d2">' || weight || '</data></edge>' FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) - 1 AS number FROM edges)"""


@query("graphml", f"WITH {GRAPHML_SQL}")
def _(spark, d):
    p = _pairs(spark, d)
    names = p.select("motif_id").distinct().withColumn("name", F.upper("motif_id"))
    return analytics.graphml_lines(analytics.cooccurrence(p), analytics.node_counts(p), names)


@query("markdown_rows", r"""SELECT doc_id, '| ' || doc_id || ' | ' || replace(replace(replace(replace(replace(replace(CASE WHEN length(t) > 200 THEN substr(t, 1, 199) || '…' ELSE t END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '|', '\|') || ' |' AS line FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents)""")
def _(spark, d):
    return analytics.markdown_rows(documents(spark, d), ["doc_id", "text"]).select("doc_id", "line")


def _shown(spark, d):
    return analytics.non_overlapping(findings(spark, d), "scene_id")


GREEDY_SQL = FINDINGS_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY s, e, motif_id, finding_id) AS n FROM findings), g(scene_id, n, last, kept, motif_id, finding_id) AS (SELECT scene_id, n, e, true, motif_id, finding_id FROM o WHERE n = 1 UNION ALL SELECT o.scene_id, o.n, CASE WHEN o.s >= g.last THEN o.e ELSE g.last END, o.s >= g.last, o.motif_id, o.finding_id FROM g JOIN o ON o.scene_id = g.scene_id AND o.n = g.n + 1)"


@query("non_overlapping_spans", f"WITH RECURSIVE {GREEDY_SQL} SELECT scene_id, finding_id FROM g WHERE kept")
def _(spark, d):
    return _shown(spark, d).select("scene_id", "finding_id")


@query("legend", f"WITH RECURSIVE {GREEDY_SQL} SELECT motif_id, count(*)::BIGINT AS shown FROM g WHERE kept GROUP BY motif_id")
def _(spark, d):
    return analytics.legend(_shown(spark, d)).drop("colour")


def _html(x: str) -> str:
    for code, name in ((38, "&amp;"), (60, "&lt;"), (62, "&gt;"), (34, "&quot;"), (39, "&#x27;")):
        x = f"replace({x}, chr({code}), '{name}')"
    return x


HTML_SQL = GREEDY_SQL + f""", k AS (SELECT g.scene_id, o.s, o.e, o.motif_id, lag(o.e, 1, 0) OVER (PARTITION BY g.scene_id ORDER BY o.s, o.e) AS before FROM g JOIN o ON o.scene_id = g.scene_id AND o.n = g.n WHERE kept),
m AS (SELECT d.doc_id, k.s, k.e, {_html("substr(text, least(before, length(text)) + 1, greatest(0, least(k.s, length(text)) - least(before, length(text))))")} || '<mark data-motif="' || motif_id || '">' || {_html("substr(text, least(k.s, length(text)) + 1, greatest(0, least(k.e, length(text)) - least(k.s, length(text))))")} || '</mark>' AS piece FROM documents d JOIN k ON d.doc_id = k.scene_id),
j AS (SELECT doc_id, string_agg(piece, '' ORDER BY s, e) AS marked, max(e) AS last FROM m GROUP BY doc_id)"""


@query("highlighted_html", f"WITH RECURSIVE {HTML_SQL} SELECT d.doc_id AS scene_id, sha256(coalesce(marked, '') || {_html("substr(text, least(coalesce(last, 0), length(text)) + 1)")}) AS html_sha FROM documents d LEFT JOIN j USING (doc_id)")
def _(spark, d):
    texts = documents(spark, d).select(F.col("doc_id").alias("scene_id"), "text")
    pages = analytics.highlighted(texts, _shown(spark, d), "scene_id")
    return pages.select("scene_id", F.sha2(F.col("html").cast("binary"), 256).alias("html_sha"))


REPORT_SQL = FINDINGS_SQL + ", " + HITS_BY_SCENE + """, su AS (SELECT scene_id, string_agg(rank || '. ' || chunk_id, chr(10) ORDER BY rank) AS x FROM h WHERE rank <= 3 GROUP BY scene_id),
y AS (SELECT scene_id, string_agg(motif_id || ' lex=1 sem=0.50 weight=1.00', chr(10) ORDER BY motif_id) AS x FROM (SELECT DISTINCT scene_id, motif_id FROM findings) GROUP BY scene_id),
l AS (SELECT scene_id, confidence, s, '- ' || CASE WHEN confidence >= 0.5 THEN '**' || motif_id || '**' ELSE motif_id END || ' ' || round(confidence::DECIMAL(18, 9), 2)::DECIMAL(9, 2) || ' said' AS line FROM findings),
f AS (SELECT scene_id, string_agg(line, chr(10) ORDER BY confidence DESC, s, line) AS x FROM l GROUP BY scene_id)"""


@query("support_reports", f"WITH {REPORT_SQL} SELECT f.scene_id, concat_ws(chr(10), 'Support', su.x, 'Sanity', y.x, 'Findings', f.x) AS report FROM f JOIN su USING (scene_id) JOIN y USING (scene_id)")
def _(spark, d):
    f = findings(spark, d).withColumn("rationale", F.lit("said"))
    s = _scene_hits(spark, d, 3).select("scene_id", "rank", F.col("chunk_id").cast("string").alias("text"))
    y = f.select("scene_id", "motif_id").distinct().select("*", F.lit(1).alias("lex_ok"), F.lit(0.5).alias("sem_sim"), F.lit(1.0).alias("weight"))
    return analytics.support_report(f.select("scene_id").distinct(), s, y, f, 0.5)


EXPORT_SQL = SCENES_SQL + r""", fs AS (SELECT event_id AS id, user_id % 10 AS work_id, event_id % 20 AS chapter, event_id % 4 AS scene, upper(event_type) AS trope, least(value / 500, 1) AS confidence, (event_id * 7) % 900 AS s, (event_id * 7) % 900 + 10 + event_id % 90 AS e FROM events),
fw AS (SELECT fs.*, w.text, length(w.text) AS n FROM fs JOIN works w USING (work_id)),
fc AS (SELECT *, least(least(s, n), least(e, n)) AS a, greatest(least(s, n), least(e, n)) AS b FROM fw),
wp AS (SELECT work_id, length(text) AS n, string_split(regexp_replace(text, '([.!?]+(?:\s+|$)|\n{2,})', '\1' || chr(1), 'g'), chr(1)) AS p FROM works),
wq AS (SELECT work_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM wp), wo AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY work_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM wq),
ws AS (SELECT work_id, i, (pos0 + length(s) - length(regexp_replace(s, '^\s+', '')))::INTEGER AS x, (pos0 + length(regexp_replace(s, '\s+$', '')))::INTEGER AS y FROM wo WHERE regexp_replace(s, '\s+', '', 'g') <> ''),
fr AS (SELECT fc.*, x, y, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN x <= (a + b) // 2 AND (a + b) // 2 < y THEN 0 ELSE 1 END, CASE WHEN x <= (a + b) // 2 AND (a + b) // 2 < y THEN 0 ELSE abs((x + y) // 2 - (a + b) // 2) END, i) AS nth FROM fc JOIN ws USING (work_id))
SELECT id, f.work_id, c.scene_idx, c.chapter_idx, trope, round(confidence, 6) AS confidence, a::INTEGER AS evidence_start, b::INTEGER AS evidence_end, sha256(substr(text, a + 1, b - a)) AS excerpt_sha, sha256(trim(regexp_replace(replace(substr(text, x + 1, y - x), chr(10), ' '), '^\s+|\s+$', '', 'g'))) AS sentence_sha
FROM fr f LEFT JOIN (SELECT s.work_id, s.chapter, s.idx, s.idx::INTEGER AS scene_idx, CASE WHEN s.chapter % 3 <> 2 THEN s.chapter::INTEGER END AS chapter_idx FROM scenes s) c ON f.work_id = c.work_id AND f.chapter = c.chapter AND f.scene = c.idx WHERE nth = 1"""


@query("finding_export", f"WITH {EXPORT_SQL}")
def _(spark, d):
    """Findings in the works made of conversations; some name a scene that is not there, some scenes no chapter."""
    e = findings(spark, d)
    key = lambda w, c, s: F.concat_ws("-", *(F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in (w, c, s)))
    f = e.withColumn("scene_id", key("work_id", F.col("finding_id") % 20, F.col("finding_id") % 4)).withColumn("level", F.lit("scene")).withColumn("model", F.lit(None).cast("string")).withColumn("rationale", F.lit("said"))
    w = works(spark, d).join(f.select("work_id").distinct(), "work_id", "left_semi")  # no other work can stand in a row
    c = segment.chapters(w)
    s = segment.scenes(c)
    chapter = F.concat_ws("-", F.col("work_id").cast("string"), F.col("chapter").cast("string"))
    s = s.select(key("work_id", "chapter", "idx").alias("scene_id"), chapter.alias("chapter_id"), "idx")
    c = c.where("idx % 3 <> 2").select(F.concat_ws("-", F.col("work_id").cast("string"), F.col("idx").cast("string")).alias("chapter_id"), "idx")
    names = f.select("motif_id").distinct().withColumn("name", F.upper("motif_id"))
    out = analytics.finding_rows(f, s, c, w, names)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("id", "work_id", "scene_idx", "chapter_idx", "trope", F.round("confidence", 6).alias("confidence"), "evidence_start", "evidence_end", sha("excerpt").alias("excerpt_sha"), sha("evidence_sentence").alias("sentence_sha"))


@query("group_names", "SELECT c_nationkey AS motif_id, min(c_mktsegment) AS group_name FROM customer GROUP BY 1")
def _(spark, d):
    return analytics.group_of(table(spark, d, "customer").select(F.col("c_nationkey").alias("motif_id"), F.col("c_mktsegment").alias("group_name")))


@query("hues", "SELECT DISTINCT source, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(source, ''), lambda x: ord(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296) % 360)::INTEGER AS hue FROM documents")
def _(spark, d):
    return documents(spark, d).select("source").distinct().select("source", T.hue(F.col("source")).alias("hue"))


@query("listed_lookup", "SELECT c_custkey, array_to_string([n_name for n_name in [(SELECT n_name FROM nation WHERE n_nationkey = c_nationkey), (SELECT n_name FROM nation WHERE n_nationkey = 3)] if n_name IS NOT NULL], '|') AS names FROM customer")
def _(spark, d):
    lists = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("long"), F.lit(3).cast("long"), F.lit(-1).cast("long")).alias("ids"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    return tables.in_listed_order(lists, "c_custkey", "ids", n, "id", "n_name").select("c_custkey", F.array_join("values", "|").alias("names"))


@query("sentence_snap", r"""WITH p AS (SELECT doc_id, length(text) AS n, string_split(regexp_replace(text, '((?:[.!?]|—)+\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents), q AS (SELECT doc_id, n, unnest(p) AS s, unnest(range(len(p))) AS i FROM p), c AS (SELECT doc_id, n, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM q) SELECT doc_id, coalesce(max(c) FILTER (c <= 60), 0)::INTEGER AS s_start, coalesce(min(c) FILTER (c >= 90), n)::INTEGER AS s_end FROM c GROUP BY doc_id, n""")
def _(spark, d):
    s = spans.snapped_to_sentences(F.col("text"), F.lit(60), F.lit(90))
    return documents(spark, d).select("doc_id", s["start"].alias("s_start"), s["end"].alias("s_end"))


@query("logistic_fits")
def _(spark, d):
    return calibrate.fit_logistic(points(spark, d), ["confidence"], "motif_id", steps=100)
