"""Counts, pivots, co-occurrence and reports over findings (work_id, scene_id, motif_id, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.numbers import clamped, clipped, greedy_spans
from storyloom.functions.text import escaped_html, escaped_xml, pastel, truncated

from .spans import sentence_zones

ZONE_CELL = 256  # code points: few sentences begin in one


def top_motifs(findings: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    """Motifs in most scenes, then with most findings, then by name."""
    counted = findings.groupBy("motif_id").agg(F.countDistinct("scene_id").alias("scenes"), F.count("*").alias("hits"))
    return counted.join(names.select("motif_id", "name"), "motif_id").orderBy(F.desc("scenes"), F.desc("hits"), F.lower("name"), "motif_id").limit(n)


def scene_maximum(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scene_id", "motif_id").agg(F.max("confidence").alias("confidence"))


def heatmap(findings: DataFrame, motifs: list[str]) -> DataFrame:
    """scene_id and a column for each motif: its greatest confidence there, 0 to 1, 0 where it has none."""
    cells = findings.groupBy("scene_id").pivot("motif_id", motifs).agg(F.max("confidence"))
    return cells.select("scene_id", *(clamped(F.coalesce(F.col(f"`{m}`"), F.lit(0.0))).alias(m) for m in motifs))


def scene_motifs(findings: DataFrame, threshold: float = 0.25, accepted: DataFrame | None = None) -> DataFrame:
    """Distinct (scene_id, motif_id) of findings at the threshold or above; of accepted ones only, if given."""
    rows = findings.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    if accepted is not None:
        rows = rows.join(accepted.where("decision = 'accept'").select("finding_id"), "finding_id", "left_semi")
    return rows.select("scene_id", "motif_id").distinct()


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """src, dst (src < dst), weight: scenes that both are in. Pairs are made within a scene's set of motifs, which
    the catalog bounds, without a self-join."""
    sets = pairs.groupBy("scene_id").agg(F.sort_array(F.collect_set("motif_id")).alias("m"))
    left = sets.select("m", F.posexplode("m").alias("i", "src"))
    edges = left.select("src", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("dst"))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def node_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("motif_id").agg(F.countDistinct("scene_id").alias("scenes"))


def strongest(edges: DataFrame, nodes: DataFrame, top: int = 20, least: int = 1) -> DataFrame:
    """Edges among the `top` nodes with at least that weight, and alpha, the weight scaled to 0.2 .. 1."""
    kept = nodes.orderBy(F.desc("scenes"), "motif_id").limit(top).select("motif_id")
    rows = edges.where(F.col("weight") >= least).join(kept.withColumnRenamed("motif_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("motif_id", "dst"), "dst", "left_semi")
    ends = rows.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    alpha = F.when(F.col("high") > F.col("low"), 0.2 + 0.8 * (F.col("weight") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0))
    return rows.crossJoin(F.broadcast(ends)).select("src", "dst", "weight", alpha.alias("alpha"))  # one row


def graphml_lines(edges: DataFrame, nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """part (0 node, 1 edge), number (their order: by count or weight, then ids), line. Nodes have a label (the name of
    names, motif_id and name, or the id) and a count, edges an id and a weight. The catalog bounds the graph."""
    named = nodes.join(names.select("motif_id", "name"), "motif_id", "left") if names is not None else nodes.withColumn("name", F.lit(None).cast("string"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    label = escaped_xml(F.coalesce("name", F.col("motif_id")))
    node = text('<node id="', escaped_xml(F.col("motif_id")), '"><data key="d0">', label, '</data><data key="d1">', F.col("scenes").cast("string"), "</data></node>")
    n = named.select(F.lit(0).alias("part"), (F.row_number().over(Window.orderBy(F.desc("scenes"), "motif_id")) - 1).alias("number"), node.alias("line"))
    number = F.row_number().over(Window.orderBy(F.desc("weight"), "src", "dst")) - 1
    e = edges.select(F.lit(1).alias("part"), number.alias("number"), "src", "dst", "weight")
    edge = text('<edge id="e', F.col("number").cast("string"), '" source="', escaped_xml(F.col("src")), '" target="', escaped_xml(F.col("dst")), '"><data key="d2">', F.col("weight").cast("string"), "</data></edge>")
    return n.unionByName(e.select("part", "number", edge.alias("line")))


def markdown_cell(c: Column) -> Column:
    """At most 200 characters, escaped for HTML and for a table."""
    return F.replace(escaped_html(truncated(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), 200)), F.lit("|"), F.lit("\\|"))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(c).cast("string")) for c in columns)), F.lit(" |")))


def non_overlapping(findings: DataFrame, by: str) -> DataFrame:
    """Of each group's spans, in order, those that start at or after the end of the last one kept."""
    spans = F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "motif_id", "finding_id"))
    kept = findings.groupBy(by).agg(greedy_spans(spans).alias("s")).select(by, F.explode("s").alias("s"))
    return kept.select(by, "s.*")


def legend(kept: DataFrame) -> DataFrame:
    """motif_id, shown, colour: how often each stands in the report."""
    return kept.groupBy("motif_id").agg(F.count("*").alias("shown")).withColumn("colour", pastel(F.col("motif_id")))


def highlighted(texts: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """by, html: the escaped text with a mark around each kept span."""
    spans = kept.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", "end", "motif_id"))).alias("s"))
    rows = texts.join(spans, by, "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,end:int,motif_id:string>>")))
    n = F.length("text")
    cut = lambda a, b: escaped_html(F.col("text").substr(F.least(a, n) + 1, F.greatest(F.lit(0), F.least(b, n) - F.least(a, n))))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("s"), i - 1)["end"])
    marked = F.transform("s", lambda x, i: F.concat(cut(before(i), x["start"]), F.lit('<mark data-motif="'), escaped_html(x["motif_id"]), F.lit('">'), cut(x["start"], x["end"]), F.lit("</mark>")))
    rest = cut(F.coalesce(F.get(F.col("s"), F.size("s") - 1)["end"], F.lit(0)), n)
    return rows.select(by, F.concat(F.array_join(marked, ""), rest).alias("html"))


def support_report(scenes: DataFrame, supports: DataFrame, sanity: DataFrame, findings: DataFrame, threshold: float) -> DataFrame:
    """scene_id, report: each scene's supports, sanity rows and findings as text."""
    lines = lambda df, order, line, name: df.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("l")))).alias("x")).select("scene_id", F.array_join("x.l", "\n").alias(name))
    s = lines(supports, ["rank"], F.format_string("%d. %s", "rank", truncated(F.col("text"), 480)), "s")
    y = lines(sanity, ["motif_id"], F.format_string("%s lex=%d sem=%.2f weight=%.2f", "motif_id", "lex_ok", "sem_sim", "weight"), "y")
    bold = F.when(F.col("confidence") >= threshold, F.lit("**")).otherwise(F.lit(""))
    f = lines(findings, [(-F.col("confidence")).alias("o"), F.col("start").alias("p")], F.concat(F.lit("- "), bold, F.col("motif_id"), bold, F.format_string(" %.2f ", "confidence"), truncated(F.coalesce("rationale", F.lit("")), 120)), "f")
    out = scenes.select("scene_id").join(s, "scene_id", "left").join(y, "scene_id", "left").join(f, "scene_id", "left")
    blank = lambda c: F.coalesce(c, F.lit("(none)"))
    return out.select("scene_id", F.concat_ws("\n", F.lit("Support"), blank("s"), F.lit("Sanity"), blank("y"), F.lit("Findings"), blank("f")).alias("report"))


def group_of(motif_groups: DataFrame) -> DataFrame:
    """One group name for each motif: the least."""
    return motif_groups.groupBy("motif_id").agg(F.min("group_name").alias("group_name"))


def finding_rows(findings: DataFrame, scenes: DataFrame, chapters: DataFrame, works: DataFrame, names: DataFrame) -> DataFrame:
    """Findings as they are exported: id, work_id, scene_idx, chapter_idx (null where there is no such scene or chapter),
    trope, level, confidence, created_at, model, evidence_start, evidence_end (inside the text, the right way round),
    excerpt, evidence_sentence and rationale.

    scenes: scene_id, chapter_id, idx; chapters: chapter_id, idx; works: work_id, text; names: motif_id, name. Findings
    of a work or motif that is not there are left out."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    whole = works.select("work_id", "text")
    placed = findings.withColumn("_from", F.coalesce("start", F.lit(0))).withColumn("_to", F.coalesce("end", F.lit(0)))
    a, b = clipped(F.col("_from"), F.col("_to"), F.length("text"))
    cut = lambda x, y: F.col("text").substr(x + 1, y - x)
    # Excerpt and sentence depend on the work and the span alone: each span once, its sentence by number of a zone.
    spots = placed.select("work_id", "_from", "_to").distinct().join(whole, "work_id")
    spots = spots.select("work_id", "_from", "_to", a.cast("int").alias("evidence_start"), b.cast("int").alias("evidence_end"), cut(a.cast("int"), b.cast("int")).alias("excerpt"))
    spots = spots.withColumn("_middle", F.floor((F.col("evidence_start") + F.col("evidence_end")) / 2)).withColumn("_cell", F.floor(F.col("_middle") / ZONE_CELL))
    zones = sentence_zones(whole, "work_id", ZONE_CELL).withColumnsRenamed({"work_id": "_work", "_cell": "_zone"})
    here = (F.col("work_id") == F.col("_work")) & (F.col("_cell") == F.col("_zone")) & (F.col("_middle") >= F.col("zone_start")) & (F.col("_middle") < F.col("zone_end"))
    spots = spots.join(zones, here, "left")
    sentence = F.regexp_replace(F.replace(F.col("sentence"), F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")
    spots = spots.select("work_id", "_from", "_to", "evidence_start", "evidence_end", "excerpt", sentence.alias("evidence_sentence"))
    rows = placed.join(names.select("motif_id", F.col("name").alias("trope")), "motif_id").join(spots, ["work_id", "_from", "_to"])
    inside = scenes.select("scene_id", "chapter_id", F.col("idx").alias("scene_idx")).join(chapters.select("chapter_id", F.col("idx").alias("chapter_idx")), "chapter_id", "left")
    rows = rows.join(inside.drop("chapter_id"), "scene_id", "left")
    return rows.select(
        F.col("finding_id").alias("id"), "work_id", "scene_idx", "chapter_idx", "trope", empty("level").alias("level"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "created_at", empty("model").alias("model"), "evidence_start", "evidence_end", "excerpt", "evidence_sentence", empty("rationale").alias("rationale"),
    )


def tooltip(name: Column, group: Column, confidence: Column, rationale: Column) -> Column:
    """Name, group, confidence and the beginning of the rationale, as far as there are any."""
    said = F.replace(F.substring(rationale, 1, 240), F.lit("\n"), F.lit(" "))
    return F.concat_ws(" | ", name, F.concat(F.lit("["), group, F.lit("]")), F.format_string("conf=%.2f", F.coalesce(confidence, F.lit(0.0))), F.nullif(said, F.lit("")))


def _stitched(text: Column, spans: Column, opened) -> Column:
    """The escaped text with a mark around each span (array<struct<start, end, ...>> in order, none overlapping);
    opened(span) is the mark's opening tag."""
    n = F.length(text)
    cut = lambda a, b: escaped_html(text.substr(F.least(a, n) + 1, F.greatest(F.lit(0), F.least(b, n) - F.least(a, n))))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    marked = F.transform(spans, lambda x, i: F.concat(cut(before(i), x["start"]), opened(x), cut(x["start"], x["end"]), F.lit("</mark>")))
    return F.concat(F.array_join(marked, ""), cut(F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)), n))


def report_pages(works: DataFrame, findings: DataFrame) -> DataFrame:
    """work_id, title, legend, html: one page a work, the text with a mark for each finding that starts at or after the end
    of the one before, and a legend of the motifs shown, the most frequent first, then by name.

    works: work_id, title, text; findings: work_id, finding_id, start, end, name, group_name, url, confidence,
    rationale (group, url and rationale may be null). Colours go by the group where there is one. Spans are cut to the
    text; empty ones and those beyond it are left out. A work without findings has its text and says so."""
    rows = findings.join(works.select("work_id", F.length("text").alias("_n")), "work_id")
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("_n"))).cast("int")
    rows = rows.where((F.col("end") > F.col("start")) & (F.col("start") < F.col("_n")))
    tip = tooltip(F.col("name"), F.col("group_name"), F.col("confidence"), F.col("rationale"))
    key = F.coalesce("group_name", "name")
    span = F.struct(inside("start").alias("start"), inside("end").alias("end"), "name", F.col("finding_id"), tip.alias("tip"), pastel(key).alias("colour"), pastel(key, "0.55").alias("swatch"), "group_name", "url")
    kept = rows.groupBy("work_id").agg(greedy_spans(F.collect_list(span)).alias("s"))
    shown = kept.select("work_id", F.explode("s").alias("s")).groupBy("work_id", F.col("s.name").alias("name"))
    shown = shown.agg(F.count("*").alias("n"), F.first("s.swatch").alias("swatch"), F.first("s.group_name").alias("group"), F.first("s.url").alias("url"))
    link = F.when(F.col("url") != "", F.concat(F.lit('<a href="'), escaped_html(F.col("url")), F.lit('" target="_blank" rel="noopener noreferrer">'), escaped_html(F.col("name")), F.lit("</a>"))).otherwise(escaped_html(F.col("name")))
    group = F.coalesce(F.concat(F.lit(" <small>["), escaped_html(F.col("group")), F.lit("]</small>")), F.lit(""))
    item = F.concat(F.lit('<li><span style="background:'), F.col("swatch"), F.lit('"></span>'), F.coalesce(link, escaped_html(F.col("name"))), group, F.lit(" <small>×"), F.col("n").cast("string"), F.lit("</small></li>"))
    legends = shown.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.lower("name").alias("l"), item.alias("item")))).alias("i"))
    legends = legends.select("work_id", F.concat(F.lit("<ul>"), F.array_join("i.item", ""), F.lit("</ul>")).alias("legend"))
    out = works.select("work_id", "title", "text").join(kept, "work_id", "left").join(legends, "work_id", "left")
    opened = lambda x: F.concat(F.lit('<mark title="'), escaped_html(x["tip"]), F.lit('" style="background:'), x["colour"], F.lit('">'))
    html = F.when(F.size("s") > 0, _stitched(F.col("text"), F.col("s"), opened)).otherwise(escaped_html(F.col("text")))
    return out.select("work_id", "title", F.coalesce("legend", F.lit("<ul><li><small>No findings</small></li></ul>")).alias("legend"), F.coalesce(html, F.lit("")).alias("html"))


def highlight_pages(works: DataFrame, scenes: DataFrame, findings: DataFrame) -> DataFrame:
    """work_id, title, jumps, html: a list of all findings that leads to their marks, and the scenes with the marks.

    works: work_id, title; scenes: work_id, scene_id, idx, char_start, char_end, text; findings: work_id, scene_id,
    finding_id, start, end (in the work), name. Marks carry the finding's id; a finding whose span starts inside the
    one before it in its scene is in the list but has no mark of its own."""
    listed = findings.join(scenes.select("scene_id", "idx"), "scene_id", "left")
    place = F.format_string(" <small>(scene %s, %d–%d)</small></li>", F.coalesce(F.col("idx").cast("string"), F.lit("?")), "start", "end")
    jump = F.concat(F.lit('<li><a href="#" data-jump="'), escaped_html(F.col("finding_id").cast("string")), F.lit('">'), escaped_html(F.col("name")), F.lit("</a>"), place)
    jumps = listed.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("scene_id", "start", "end", jump.alias("j")))).alias("x")).select("work_id", F.concat(F.lit("<ol>"), F.array_join("x.j", ""), F.lit("</ol>")).alias("jumps"))
    inner = findings.join(scenes.select("scene_id", "char_start"), "scene_id")
    relative = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("char_start")).cast("int")
    span = F.struct(relative("start").alias("start"), relative("end").alias("end"), F.col("finding_id").cast("string").alias("id"), "name")
    kept = inner.where(relative("end") > relative("start")).groupBy("scene_id").agg(greedy_spans(F.collect_list(span)).alias("s"))
    opened = lambda x: F.concat(F.lit('<mark data-span-id="'), escaped_html(x["id"]), F.lit('" title="'), escaped_html(x["name"]), F.lit('">'))
    rows = scenes.join(kept, "scene_id", "left")
    body = F.when(F.size("s") > 0, _stitched(F.col("text"), F.col("s"), opened)).otherwise(escaped_html(F.col("text")))
    scene = F.concat(F.format_string("<h3>Scene %d <small>[%d–%d]</small></h3><pre>", "idx", "char_start", "char_end"), body, F.lit("</pre>"))
    pages = rows.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "idx", scene.alias("h")))).alias("x")).select("work_id", F.array_join("x.h", "").alias("html"))
    out = works.select("work_id", "title").join(jumps, "work_id", "left").join(pages, "work_id", "left")
    return out.select("work_id", "title", F.coalesce("jumps", F.lit("<ol></ol>")).alias("jumps"), F.coalesce("html", F.lit("")).alias("html"))
