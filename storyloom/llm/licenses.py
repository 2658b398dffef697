"""License scans in DataFrame functions: a trained paragraph classifier, confirmed by template comparison.

Features are the words and word pairs of licence texts; sparse weights come from a softmax regression with an L1
penalty that is trained on the driver on those texts, whole, worn and in pieces, with prose around them. Beside the
families there are two classes: `unknown`, licence language of no family (other licences' notices, under invented
names), and none, prose in which the same words mean something else. The weights (fixed by the texts, some two
thousand rows) are broadcast and joined to a line's distinct n-grams; sums give class probabilities at a
temperature set on held-out paragraphs.

A paragraph is a run of neighbouring lines of licence language, so that wrapped notices are read as a whole; blank
lines don't end it, a line that holds a text of another family than the run so far does. A family is confirmed
if the paragraph holds enough of one of its texts, or is itself a piece of one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, table
from .license_texts import COMMON, NAMES, NEAR_MISSES, OTHERS, TEXTS

UNKNOWN, NONE = "unknown", "none"
STOP = frozenset(COMMON) | frozenset("x s d t r http https www com org 0 1 2 3 4 5 v its such other any if no may must shall should been used so than then there these those do does".split())
VARIANTS, PIECES, PROSE = 14, 14, 1500
CONFIDENT, CONTAINED, INSIDE, LEAST_SHARED = 0.5, 0.75, 0.9, 8
BREAK = r"\n(?: *\n)*"  # blank lines belong to the break
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return "".join(c if c in LOWER or c in "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()


def grams_of(text: str) -> set[str]:
    """Words of a-z and 0-9 and pairs of neighbours, without those of stop words alone."""
    words = words_of(text)
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP}


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]  # families, unknown, none
    bias: tuple[float, ...]  # already divided by the temperature, as are the weights
    weights: tuple[tuple[str, tuple[float, ...]], ...]
    templates: tuple[tuple[int, str, int, tuple[str, ...]], ...]  # number, family, n-grams of its own, those n-grams
    temperature: float


def _paragraphs(seed: int) -> list[tuple[str, int]]:
    """Worn texts, pieces of texts, notices of other licences, and prose."""
    rng = np.random.default_rng(seed)
    prose = lambda n: [str(x) for x in rng.choice(COMMON, n)]
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = []
    for c, texts in enumerate(TEXTS.values()):
        for text in texts:
            words = text.split()
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > rng.choice([0, 0, 0.05, 0.12])]
                out.append((" ".join([*prose(pick((0, 0, 4, 12))), *kept, *prose(pick((0, 0, 4, 12)))]), c))
            for _ in range(PIECES if len(words) > 12 else 0):
                n = int(rng.integers(6, 17))
                at = int(rng.integers(0, max(1, len(words) - n)))
                out.append((" ".join([*prose(pick((0, 0, 3))), *words[at : at + n], *prose(pick((0, 0, 3)))]), c))
    for k in range(len(OTHERS) * 2 * VARIANTS):
        words = OTHERS[k % len(OTHERS)].format(pick(NAMES), rng.integers(1, 99)).split()
        out.append((" ".join([*prose(pick((0, 0, 4))), *words, *prose(pick((0, 0, 4)))]), len(TEXTS)))
    for _ in range(PROSE):
        near = pick(NEAR_MISSES).split() if rng.random() < 0.7 else []
        if near and rng.random() < 0.3:
            near = near[int(rng.integers(len(near))) :]
        out.append((" ".join([*prose(rng.integers(0, 20)), *near, *prose(rng.integers(0, 20))]), len(TEXTS) + 1))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class _Rows:
    """A sparse 0/1 matrix of paragraphs by n-grams, and its products."""

    def __init__(self, texts: list[str], place: dict[str, int]):
        columns = [sorted(place[g] for g in grams_of(t) if g in place) or [len(place)] for t in texts]  # the last column is always there, of no weight
        self.column = np.array([c for row in columns for c in row], np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(row) for row in columns])[:-1]])
        self.row = np.repeat(np.arange(len(columns)), [len(row) for row in columns])
        self.by_column = np.argsort(self.column, kind="stable")
        self.columns, self.column_start = np.unique(self.column[self.by_column], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.column], self.start, axis=0)

    def transposed_times(self, d: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, d.shape[1]))
        out[self.columns] = np.add.reduceat(d[self.row[self.by_column]], self.column_start, axis=0)
        return out


@lru_cache(1)
def train_licenses(steps: int = 160, rate: float = 4.0, penalty: float = 2e-5) -> LicenseModel:
    """Softmax regression by accelerated proximal gradient steps; deterministic, a few seconds on the driver."""
    vocabulary = sorted({g for texts in (*TEXTS.values(), OTHERS, NEAR_MISSES) for t in texts for g in grams_of(t)})
    place = {g: i for i, g in enumerate(vocabulary)}
    classes = (*TEXTS, UNKNOWN, NONE)
    texts, y = zip(*_paragraphs(1), strict=True)
    x, target = _Rows(list(texts), place), np.eye(len(classes))[list(y)]
    size = len(place) + 1
    w, b = np.zeros((size, len(classes))), np.zeros(len(classes))
    ahead, before = w, w
    for t in range(steps):
        d = (_softmax(x.times(ahead) + b) - target) / len(y)
        w = ahead - rate * x.transposed_times(d, size)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        w[-1] = 0
        b = b - rate * d.sum(0)
        ahead, before = w + t / (t + 3) * (w - before), w
    held, truth = zip(*_paragraphs(2), strict=True)
    z, truth = _Rows(list(held), place).times(w) + b, np.array(truth)
    temperature = float(min(np.geomspace(0.3, 3, 47), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()))
    rounded = lambda v: tuple(float(round(q / temperature, 4)) + 0.0 for q in v)
    weights = [(g, rounded(w[i])) for g, i in place.items()]
    templates = [(f, tuple(sorted(grams_of(t)))) for f, texts in TEXTS.items() for t in texts]
    return LicenseModel(classes, rounded(b), tuple(x for x in weights if any(x[1])), tuple((k, f, len(own), own) for k, (f, own) in enumerate(templates)), temperature)


def _table(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _judged(rows: DataFrame, model: LicenseModel, notices: DataFrame) -> DataFrame:
    """Adds class, predicted, probability, p_none, template, contained and confirmed to rows with met (array of distinct
    struct<gram, v>) and n_own (their number of distinct n-grams, also of those without a weight)."""
    logit = lambda b, c: F.aggregate("met", b, lambda s, m: s + F.get(m["v"], c))
    rows = rows.withColumn("z", F.transform(F.array(*map(F.lit, model.bias)), logit)).withColumn("top", F.array_max("z"))
    rows = rows.withColumn("class", (F.array_position("z", F.col("top")) - 1).cast("int")).withColumn("total", F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top"))))
    rows = rows.withColumn("probability", 1 / F.col("total")).withColumn("p_none", F.exp(F.element_at("z", -1) - F.col("top")) / F.col("total")).drop("z", "top", "total")
    rows = rows.join(F.broadcast(notices), "class", "left")
    share = lambda t: F.size(F.array_intersect(t["own"], F.col("met.gram")))
    rows = rows.withColumn("best", F.array_max(F.transform("notices", lambda t: F.struct((share(t) / t["size"]).alias("contained"), share(t).alias("shared"), (-t["template"]).alias("template")))))
    piece = (F.col("best.shared") >= LEAST_SHARED) & (F.col("best.shared") >= INSIDE * F.col("n_own"))
    confirmed = F.coalesce((F.col("probability") >= CONFIDENT) & ((F.col("best.contained") >= CONTAINED) | piece), F.lit(False))
    names = F.array(*map(F.lit, model.classes))
    return rows.withColumn("confirmed", confirmed).withColumn("predicted", F.element_at(names, F.col("class") + 1))


def _words(line: str) -> Column:
    """Words of a-z and 0-9 in lower case; one empty word where there is none."""
    return F.split(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def _pairs(words: str) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row for each paragraph of licence language: doc_id, paragraph (number of its first line, from 0; blank
    lines don't count), lines (of licence language in it), family (`unknown` if none is likely enough or its texts don't confirm it), predicted
    (the likeliest class, confirmed or not), probability (of that class), template (number of the nearest text
    of that family), contained (the share of its n-grams that the paragraph holds) and confirmed.

    Null and empty texts have none; null doc_id stays; repeated rows are one document, rows of one doc_id with
    different texts are told apart; ties go to the first class and the first text; an empty table gives no rows;
    other columns are left behind.
    """
    model = model or train_licenses()
    spark = docs.sparkSession
    number = lambda v: f"{v!r}D"
    weights = _table(spark, [f"('{g}', array({', '.join(map(number, v))}))" for g, v in model.weights], "gram, v")
    own = _table(spark, [f"({t}, {model.classes.index(f)}, {n}, array({', '.join(repr(g) for g in grams)}))" for t, f, n, grams in model.templates], "template, class, size, own")
    notices = own.groupBy("class").agg(F.collect_list(F.struct("template", "size", "own")).alias("notices"))
    keys = ["doc_id", "copy"]
    lines = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", BREAK)).alias("place", "line"))
    grams = lines.select("*", _words("line").alias("words")).select(*keys, "place", "line", F.explode(F.concat("words", _pairs("words"))).alias("gram"))
    met = grams.join(F.broadcast(weights), "gram")  # rows fixed by the texts
    met = met.groupBy(*keys, "place").agg(F.collect_set(F.struct("gram", "v")).alias("met"), F.first("line").alias("line"))
    like = _judged(met.withColumn("n_own", F.lit(None).cast("int")), model, notices).where("p_none < 0.5")
    sure = F.when((F.col("probability") >= CONFIDENT) & (F.col("best.contained") >= CONTAINED), F.col("class"))
    like = like.select(*keys, "place", "met", sure.alias("sure"), _words("line").alias("words"))
    stop = lambda w: w.isin(*sorted(STOP))
    own_words = F.array_distinct(F.filter("words", lambda w: ~stop(w) & (w != "")))
    own_pairs = F.array_distinct(F.filter(_pairs("words"), lambda p: ~(stop(F.substring_index(p, " ", 1)) & stop(F.substring_index(p, " ", -1)))))
    like = like.withColumn("n_own", F.size(own_words) + F.size(own_pairs)).drop("words")
    in_order = Window.partitionBy(*keys).orderBy("place")
    gap = F.coalesce((F.col("place") - F.lag("place").over(in_order) > 1).cast("int"), F.lit(0))
    like = like.withColumn("gap", gap).withColumn("run", F.sum("gap").over(in_order))
    in_run = Window.partitionBy(*keys, "run").orderBy("place")
    so_far = F.last("sure", ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    like = like.withColumn("other", F.coalesce((F.col("sure") != so_far).cast("int"), F.lit(0))).withColumn("part", F.sum("other").over(in_run))
    whole = like.groupBy(*keys, "run", "part").agg(
        F.min("place").alias("paragraph"), F.count("*").cast("int").alias("lines"), F.sum("n_own").alias("n_own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))).alias("met")
    )
    judged = _judged(whole, model, notices)
    family = F.when(F.col("confirmed"), F.col("predicted")).otherwise(F.lit(UNKNOWN))
    return judged.where(F.col("predicted") != NONE).select(
        "doc_id", "paragraph", "lines", family.alias("family"), "predicted", F.round("probability", 5).alias("probability"),
        (-F.col("best.template")).cast("int").alias("template"), F.round("best.contained", 5).alias("contained"), "confirmed",
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every whole text of documents; see scan_licenses for odd rows."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    m = train_licenses()
    k = len(m.classes)
    weights = ", ".join(f"('{g}', [{', '.join(map(repr, v))}]::DOUBLE[])" for g, v in m.weights)
    notices = ", ".join(f"({t}, {m.classes.index(f)}, [{', '.join(repr(g) for g in grams)}])" for t, f, _, grams in m.templates)
    names = ", ".join(map(repr, m.classes))
    stop = ", ".join(map(repr, sorted(STOP)))
    sums = ", ".join(f"coalesce(list_sum(list_transform(met, lambda x: x.v[{c + 1}])), 0) + ({m.bias[c]!r})" for c in range(k))

    def judged(rows: str, name: str, keys: str) -> str:
        return f"""
{name}z AS (SELECT *, [{sums}] AS z FROM {rows}),
{name}p AS (SELECT *, list_position(z, list_max(z)) - 1 AS class, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS probability, list_transform(met, lambda x: x.gram) AS g FROM {name}z),
{name}n AS (SELECT {keys}, max(struct_pack(contained := len(list_intersect(own, g)) / len(own), shared := len(list_intersect(own, g)), template := -template)) AS best FROM {name}p JOIN notices USING (class) GROUP BY {keys}),
{name} AS (SELECT {name}p.*, probability * exp(z[{k}] - list_max(z)) AS p_none, best, coalesce(probability >= {CONFIDENT} AND (best.contained >= {CONTAINED} OR best.shared >= {LEAST_SHARED} AND best.shared >= {INSIDE} * n_own), false) AS confirmed FROM {name}p LEFT JOIN {name}n USING ({keys}))"""

    return rf"""
WITH weights(gram, v) AS (VALUES {weights}), notices(template, class, own) AS (VALUES {notices}), stop AS (SELECT [{stop}] AS stop),
split AS (SELECT doc_id, regexp_split_to_array(text, '{BREAK}') AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS text FROM split),
w AS (SELECT doc_id, place, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines),
a AS (SELECT doc_id, place, list_distinct(list_concat(list_filter(w, lambda x: NOT list_contains(stop, x)),
  list_transform(list_filter(range(1, len(w)), lambda i: NOT (list_contains(stop, w[i]) AND list_contains(stop, w[i + 1]))), lambda i: w[i] || ' ' || w[i + 1]))) AS grams FROM w, stop),
e AS (SELECT doc_id, place, len(grams) AS n_own, unnest(grams) AS gram FROM a),
s AS (SELECT doc_id, place, any_value(n_own) AS n_own, list(struct_pack(gram := gram, v := v)) AS met FROM e JOIN weights USING (gram) GROUP BY ALL),
{judged("s", "judged_line", "doc_id, place")},
l AS (SELECT doc_id, place, met, n_own, CASE WHEN probability >= {CONFIDENT} AND best.contained >= {CONTAINED} THEN class END AS sure FROM judged_line WHERE p_none < 0.5),
r AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM (SELECT *, coalesce(place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > 1, false)::INTEGER AS gap FROM l)),
o AS (SELECT *, coalesce(sure <> last_value(sure IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::INTEGER AS other FROM r),
p AS (SELECT *, sum(other) OVER (PARTITION BY doc_id, run ORDER BY place) AS part FROM o),
b AS (SELECT doc_id, run, part, min(place) AS paragraph, count(*) AS lines, sum(n_own) AS n_own, list_distinct(flatten(list(met))) AS met FROM p GROUP BY doc_id, run, part),
{judged("b", "judged_block", "doc_id, run, part")}
SELECT doc_id, paragraph::INTEGER AS paragraph, lines::INTEGER AS lines, CASE WHEN confirmed THEN [{names}][class + 1] ELSE '{UNKNOWN}' END AS family, [{names}][class + 1] AS predicted,
  round(probability, 5) AS probability, (-best.template)::INTEGER AS template, round(best.contained, 5) AS contained, confirmed FROM judged_block WHERE class <> {k - 1}
"""
