"""Personal-data spans: exact base rules, loose generators, and gradient-boosted trees that choose among candidates.

Built-in functions and MLlib only. The base patterns are scanned in a form without nested repetition, so texts with very
long runs of digits, dots or separators neither overflow the stack nor rescan a run.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from adtide.llm.store import materialise

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
RANGES = 1000  # of scores, each summed up by itself

# Separators that cannot continue a match are overwritten by one other character, which keeps all positions.
_LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
_LOOSE_SEP = r"(?<![0-9])[ -]|[ -](?![0-9])"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOOSE_MAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at |@)[A-Za-z0-9-]{1,63}+"
              r"(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63}+){1,4}")
LOOSE_NUMBER = r"(?<![0-9A-Za-z])[(+]?[0-9][0-9 ().+/-]{5,30}[0-9](?![0-9A-Za-z])"
FEATURES = ("length", "digits", "groups", "longest", "dots", "dashes", "blanks", "brackets", "luhn", "octets", "at_sign", "spelled",
            "upper", "cue_mail", "cue_phone", "cue_card", "cue_host", "glued", "digit_near")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    twice = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda c, i: twice(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split(x, r"\."), lambda p: F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(hit)
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _placed(parts: Column, hits: Column) -> Column:
    """Hits with start, end (code points) and neighbouring text, from the pieces that ``split`` leaves around them."""
    pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.struct(
        F.length(p).alias("skip"), F.right(p, F.lit(24)).alias("before"), h.alias("hit")))
    pairs = F.zip_with(pairs, F.slice(parts, 2, F.size(hits)), lambda x, p: F.struct(
        x["skip"].alias("skip"), x["before"].alias("before"), x["hit"].alias("hit"), F.left(p, F.lit(2)).alias("after")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,before:string,after:string>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda a, x: F.struct(
        (a["at"] + x["skip"] + F.length(x["hit"])).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            (a["at"] + x["skip"]).alias("start"), (a["at"] + x["skip"] + F.length(x["hit"])).alias("end"),
            x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def _scan(df: DataFrame, name: str, text: Column, pattern: str, guard: Column) -> DataFrame:
    """Add column ``name``: the placed hits of ``pattern``, an empty array where ``guard`` is false."""
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_hits", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_parts", F.when(F.size("_hits") > 0, F.split(text, pattern, -1)).otherwise(none))
    return df.withColumn(name, _placed(F.col("_parts"), F.col("_hits"))).drop("_hits", "_parts")


def _feature_values(x: Column) -> dict[str, Column]:
    hit, before = x["hit"], F.lower(x["before"])
    digits = _digits(hit)
    runs = F.filter(F.split(hit, "[^0-9]+"), lambda r: r != "")
    count = lambda cls: F.length(hit) - F.length(F.regexp_replace(hit, cls, ""))
    cue = lambda words: before.rlike(words).cast("int")
    return {
        "length": F.length(hit), "digits": F.length(digits), "groups": F.size(runs),
        "longest": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)),
        "dots": count(r"\."), "dashes": count("[-/]"), "blanks": count(" "), "brackets": count(r"[()\[\]]"),
        "luhn": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False).cast("int"),
        "octets": F.when(hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), _octets(hit)).otherwise(False).cast("int"),
        "at_sign": hit.contains("@").cast("int"), "spelled": hit.rlike(r"[\[(](?:at|dot)[\])]").cast("int"), "upper": count("[A-Z]"),
        "cue_mail": cue("mail|contact|write"), "cue_phone": cue("phone|tel|call|mobile|fax"), "cue_card": cue("card|visa|credit|pay"),
        "cue_host": cue("ip|host|server|addr"), "glued": x["before"].rlike("[A-Za-z]$").cast("int"), "digit_near": x["before"].rlike("[0-9]$").cast("int"),
    }


def _threshold(scored: list[tuple[float, int]], precision: float) -> float | None:
    """Smallest score above which the labelled rows reach the precision; rows of one score are taken together. The rule
    that ``_least_score`` applies to a table."""
    best, good, rows = None, 0, sorted(scored, reverse=True)
    for i, (score, label) in enumerate(rows, 1):
        good += label
        if (i == len(rows) or rows[i][0] < score) and good >= precision * i:
            best = score
    return best


def _least_score(scored: DataFrame, precision: float) -> float | None:
    """``_threshold`` of the columns score (0 to 1) and label: sums from the top, of ranges of scores first, then inside each."""
    each = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    each = each.withColumn("range", F.floor(F.col("score") * RANGES).cast("int"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy("range").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(
        "range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "good")])
    upto = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select("range", "score", *[F.sum(c).over(upto).alias(c) for c in ("n", "good")]).join(ranges, "range")
    enough = F.col("good") + F.col("good_above") >= F.lit(precision) * (F.col("n") + F.col("n_above"))
    return sums.where(enough).agg(F.min("score")).first()[0]


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION, seed: int = 7) -> DataFrame:
    """Base spans of each document and further ones that boosted trees accept.

    Base rules (e-mail, IPv4, card, phone) give the spans that always stay. Two loose generators propose spans of any of
    these kinds, which may overlap the base ones and each other. Gradient-boosted trees score a candidate by its format
    and context, without the mark the base rule keys on (such as a phone's plus); they are fit on the candidates of half of
    the texts (by hash), labelled by overlap with a base span, and the threshold is the smallest score with the
    given precision on all candidates of the other half. (MLlib itself finds the split points of its bins on some rows.) Accepted candidates that overlap no base span are added, best score first
    where two overlap.

    Null and empty texts have no spans. Repeated rows get equal results. A document with no candidates adds nothing, nor does a
    table with fewer than 50 candidates or a single label in a half. Empty tables give no rows; columns other than id and text are ignored.
    Result: id, text_key, base and added: arrays of (kind, start, end), ends exclusive, in code points.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("text_key"))
    has_digit, has_at = F.col("text").rlike("[0-9]"), F.contains(F.col("text"), F.lit("@"))
    df = df.withColumn("digit", has_digit)
    df = _scan(df, "email", F.regexp_replace("text", _LOOSE_DOT, "_"), EMAIL, has_at)
    df = _scan(df, "ip", F.col("text"), IP, F.col("digit"))
    df = _scan(df, "card", F.regexp_replace("text", _LOOSE_SEP, "\u0001"), CARD, F.col("digit"))
    df = _scan(df, "phone", F.col("text"), PHONE, F.col("digit") & F.contains(F.col("text"), F.lit("+")))
    df = _scan(df, "mail", F.col("text"), LOOSE_MAIL, F.contains(F.col("text"), F.lit("at")) | has_at)
    df = _scan(df, "number", F.col("text"), LOOSE_NUMBER, F.col("digit"))
    span = lambda kind: F.transform(F.filter(kind, lambda x: _valid(kind, x["hit"])), lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    guess = lambda x: (
        F.when(x["hit"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.lit("ip"))
        .when(F.length(_digits(x["hit"])).between(13, 19), F.lit("card")).otherwise(F.lit("phone")))
    loose = F.concat(F.transform("mail", lambda x: F.struct(F.lit("email").alias("kind"), x.alias("x"))),
                     F.transform("number", lambda x: F.struct(guess(x).alias("kind"), x.alias("x"))))
    found = materialise(df.select("id", "text_key", F.concat(*[span(k) for k in KINDS]).alias("base"), loose.alias("loose")), "pii-spans")

    meets = F.exists("base", lambda b: (b["start"] < F.col("x.end")) & (b["end"] > F.col("x.start")))
    one = found.where(F.size("loose") > 0).select("id", "text_key", "base", F.explode("loose").alias("c")).select(
        "id", "text_key", "base", F.col("c.kind").alias("kind"), F.col("c.x").alias("x")).withColumn("label", meets.cast("int"))
    cand = one.select("id", "text_key", "kind", F.col("x.start").alias("start"), F.col("x.end").alias("end"), "label",
                      *[v.cast("double").alias(k) for k, v in _feature_values(F.col("x")).items()],
                      *[(F.col("kind") == k).cast("double").alias(f"is_{k}") for k in KINDS])
    names = [*FEATURES, *[f"is_{k}" for k in KINDS]]
    added = _choose(cand, names, precision, seed)
    if added is None:
        none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
        return found.select(F.col("id").alias(id_col), "text_key", "base", none.alias("added"))
    added = added.withColumnsRenamed({"id": "of", "text_key": "of_key"})
    return found.join(added, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left").select(
        F.col("id").alias(id_col), "text_key", "base",
        F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")).alias("added"))


def _choose(cand: DataFrame, names: list[str], precision: float, seed: int) -> DataFrame | None:
    cand = materialise(cand.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "text_key"), F.lit(2))), "pii-candidates")
    seen = {(r["fold"], r["label"]): r["count"] for r in cand.groupBy("fold", "label").count().collect()}
    if sum(seen.values()) < 50 or any((f, y) not in seen for f in (0, 1) for y in (0, 1)):
        return None
    pack = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.2, seed=seed).fit(pack.transform(cand.where("fold = 0")))
    score = F.round(vector_to_array("probability")[1], 9).alias("score")
    least = _least_score(model.transform(pack.transform(cand.where("fold = 1"))).select(score, "label"), precision)
    if least is None:
        return None
    kept = (model.transform(pack.transform(cand.where("label = 0"))).select("id", "text_key", "kind", "start", "end", score)
            .where(F.col("score") >= least).distinct())
    struct = F.struct((-F.col("score")).alias("rank"), "kind", "start", "end")
    free = lambda out, x: F.forall(out, lambda y: (y["end"] <= x["start"]) | (y["start"] >= x["end"]))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    pick = F.aggregate(F.array_sort(F.collect_list(struct)), none, lambda out, x: F.when(
        free(out, x), F.concat(out, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))).otherwise(out))
    return kept.groupBy("id", "text_key").agg(pick.alias("added"))


def span_digest(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
