"""Personal data by candidate gradient boosting, in DataFrame expressions and
Spark ML only.

*Generators* propose spans.  The strict ones are fixed patterns with a check (ip
parts, Luhn, digit counts); what passes is always redacted.  The loose ones are made
for recall - spelled-out addresses, other separators, phones without a plus, and
secrets, runs of letters and digits - and overlap freely.  *Boosted trees* score the
loose candidates from format features and from the words around them.  They are
trained on all loose candidates with a known label, but for those held back (one in four by
their hash): positive where one overlaps a strict span of its kind (a secret: where it is assigned to a name like token or key), negative
where it fails the check of its kind or overlaps a strict span of another; the numbers
that the checks stand on are no features.  A *threshold* per kind, calibrated on all
loose candidates held back, selects the spans to add: where it cannot reach
``PRECISION``, nothing is added.  ``measure`` reports precision and recall.

Edge cases: null and empty texts have no spans; ties between overlapping loose spans
go to the likelier, then the earlier, then the longer; repeated rows get the same
spans each; rows of one doc_id are told apart by their text; without both labels among
the candidates only the strict spans are found; an empty table gives no rows; extra
columns are kept by ``redact`` but for those named like an output.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.llm.common import let, materialize, without

KINDS = ["email", "ip", "card", "phone"]
#: The kinds of strict spans, then those that only the trees find.
ALL = [*KINDS, "secret"]

# The strict patterns, written so that no group can be entered twice from one place.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text with such a span passes.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
    "phone": r"\+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}"
             r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\[?\.\]? ?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])\+?\(?[0-9]{1,5}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){2,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+",
}
LOOSE_HINTS = {"email": r"@|[(\[{]at[)\]}]", "ip": r"[0-9] ?\[?\.", "card": r"[0-9][ ._/-]?[0-9]{2}",
               "phone": r"[0-9]\)?[ ./-]\(?[0-9]{2}", "secret": r"[A-Za-z0-9+/_-]{16}"}
#: Words that name a kind nearby, a regular expression for each.
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay|iban",
           "phone": "phone|tel|call|fax|mobile|cell", "secret": "token|secret|passw|pwd|key|auth|credential"}
#: What stands before a value that is assigned to a name.
ASSIGNED = r"[A-Za-z_]\w*[\"']? ?[:=] ?[\"']?$"
#: Trees, depth, precision of the calibrated thresholds.
TREES, DEPTH, PRECISION = 8, 3, 0.98
AROUND = 24

_EMPTY = "array<struct<kind:string,first:int,last:int,value:string,before:string,after:string,strict:boolean>>"


def _found(t: Column, kind: str, pattern: str, hint: str, strict: bool) -> Column:
    """Matches of ``pattern`` as an array of candidate structs."""
    def located(pair: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("out"))

        def step(a: Column, i: Column) -> Column:
            value = F.get(pair["hits"], i)
            first = a["at"] + F.char_length(F.get(pair["gaps"], i))
            last = first + F.char_length(value)
            one = F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), value.alias("value"),
                           F.right(F.get(pair["gaps"], i), F.lit(AROUND)).alias("before"),
                           F.left(F.get(pair["gaps"], i + 1), F.lit(AROUND)).alias("after"), F.lit(strict).alias("strict"))
            return F.struct(last.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(pair["hits"]) - 1), zero, step)["out"]

    pair = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hits"), F.split(t, pattern, -1).alias("gaps"))
    none = F.array().cast(_EMPTY)
    return F.when(t.rlike(hint), let(pair, lambda p: F.when(F.size(p["hits"]) > 0, located(p)).otherwise(none))).otherwise(none)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, spans): every proposal of every generator; th is a hash of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), t.alias("t"))
    parts = [_found(F.col("t"), k, STRICT[k], HINTS[k], True) for k in KINDS]
    parts += [_found(F.col("t"), k, LOOSE[k], LOOSE_HINTS[k], False) for k in ALL]
    return rows.select("doc_id", "th", F.concat(*parts).alias("spans"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string fits."""
    def total(r: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            d = F.substring(r, i + 1, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return a + F.when(i % 2 == 1, twice).otherwise(d)
        return F.aggregate(F.sequence(F.lit(0), F.char_length(r) - 1), F.lit(0), step)
    return F.when(F.char_length(digits) > 0, let(F.reverse(digits), total) % 10 == 0).otherwise(F.lit(False))


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def checked(s: Column) -> Column:
    """Whether the value of a candidate passes the check of its kind."""
    digits = _digits(s["value"])
    n = F.char_length(digits)
    return F.when(s["kind"] == "ip", s["value"].rlike(rf"^{_PART}(?:[ \[\]]*\.[ \[\]]*{_PART}){{3}}$")).when(
        s["kind"] == "card", n.between(16, 19) & F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False))).when(
        s["kind"] == "phone", n.between(8, 15)).otherwise(F.lit(True))


def plausible(s: Column) -> Column:
    """Whether a loose candidate could be of its kind: the check, and for the kinds without one a look at the characters."""
    both = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    return checked(s) & F.when(s["kind"] == "secret", both).when(s["kind"] == "email", s["value"].rlike("[A-Za-z]{2,}$")).otherwise(F.lit(True))


FEATURES = [*[f"k_{k}" for k in ALL], "size", "n_seps", "groups", "uneven", "digit_share", "named", "named_other", "glued", "sentence",
            "assigned", "quoted", "first_digit", "zeros"]


def _features(c: DataFrame) -> DataFrame:
    digits = _digits(F.col("value"))
    near = F.lower(F.concat_ws(" ", "before", "after"))
    named = F.lit(False)
    other = F.lit(False)
    for k in ALL:
        hit = near.rlike(CONTEXT[k])
        named = F.when(F.col("kind") == k, hit).otherwise(named)
        other = F.when(F.col("kind") == k, other).otherwise(other | hit)
    groups = F.split("value", "[^A-Za-z0-9]+")
    sizes = F.transform(groups, lambda g: F.char_length(g))
    # where the number of digits is checked, neither it nor what follows from it may tell the label
    counted = F.col("kind").isin("card", "phone", "ip")
    made = {f"k_{k}": F.col("kind") == k for k in ALL} | {
        "size": F.when(counted, 0).otherwise(F.least(F.char_length("value"), F.lit(200))),
        "digit_share": F.when(counted, -1.0).otherwise(F.char_length(digits) / F.char_length("value")),
        "n_seps": F.char_length("value") - F.char_length(F.regexp_replace("value", "[^A-Za-z0-9]", "")),
        "groups": F.size(groups), "uneven": F.array_max(sizes) - F.array_min(sizes), "named": named, "named_other": other,
        "glued": F.coalesce(F.right("before", F.lit(1)).rlike("[A-Za-z0-9]") | F.left("after", F.lit(1)).rlike("[A-Za-z0-9]"),
                            F.lit(False)),
        "sentence": F.coalesce(F.right("before", F.lit(2)).rlike("[.!?] ?$"), F.lit(False)),
        "assigned": F.coalesce(F.col("before").rlike(ASSIGNED), F.lit(False)),
        "quoted": F.coalesce(F.right("before", F.lit(1)).rlike("[\"']") & F.left("after", F.lit(1)).rlike("[\"']"), F.lit(False)),
        "first_digit": F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)),
        "zeros": F.when(counted, (F.char_length(digits) - F.char_length(F.regexp_replace(digits, "0", ""))) / F.char_length(digits)).otherwise(0.0)}
    typed = c.select("*", *[made[f].cast("double").alias(f) for f in FEATURES])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(typed)


def labelled(flat: DataFrame) -> DataFrame:
    """The loose candidates of ``flat`` (distinct rows) with ``label``: 1, 0 or null (not known), from the strict spans that
    pass, by windows over the candidates of a text."""
    sure = F.col("strict") & checked(F.struct("kind", "value"))

    def met(*keys: str) -> Column:
        behind = Window.partitionBy("doc_id", "th", *keys).orderBy("first").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = Window.partitionBy("doc_id", "th", *keys).orderBy("first").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        return F.coalesce(F.max(F.when(sure, F.col("last"))).over(behind) > F.col("first"), F.lit(False)) | F.coalesce(
            F.min(F.when(sure, F.col("first"))).over(ahead) < F.col("last"), F.lit(False))

    seen = flat.withColumn("same", met("kind")).withColumn("any", met()).filter(~F.col("strict"))
    able = plausible(F.struct("kind", "value"))
    named = F.lower("before").rlike(CONTEXT["secret"]) & F.col("before").rlike(ASSIGNED)
    yes = F.when(F.col("kind") == "secret", able & named & ~F.col("any")).otherwise(F.col("same"))
    return seen.withColumn("able", able).withColumn("label", F.when(yes, 1.0).when(~able | F.col("any"), 0.0)).drop("same", "any")


def fit(known: DataFrame):
    """(model, threshold of each kind, report) from all loose candidates with a known ``label``, or None if those to train on
    lack one of the labels.  report: (kind, n_held, precision, recall) of the threshold on the held-out candidates."""
    order = F.xxhash64("doc_id", "kind", "first", "value")
    split = _features(known.withColumn("held", F.pmod(order, F.lit(4)) == 0).orderBy(order, "th", "last"))  # sums in one order
    rows = materialize(split.select("kind", "label", "held", "features"), "pii-known")
    train = rows.filter(~F.col("held"))
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3).fit(train)
    scored = model.transform(rows.filter("held")).select("kind", "label", vector_to_array("probability")[1].alias("p"))
    # trees of bounded depth give few distinct scores: one row each reaches the driver
    levels = scored.groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right")).orderBy("kind", F.desc("p")).collect()
    cut, report = {}, []
    for k in ALL:
        own = [r for r in levels if r["kind"] == k]
        n, right, kept, total = 0, 0, (0, 0), sum(r["right"] for r in own)
        for r in own:
            n, right = n + r["n"], right + r["right"]
            if right >= PRECISION * n:
                cut[k], kept = r["p"], (right, n)
        report.append((k, n, kept[0] / kept[1] if kept[1] else None, kept[0] / total if total else None))
    return model, cut, report


def _apart(spans: Column, held: Column) -> Column:
    """The spans, best first, that overlap neither ``held`` nor a better one."""
    def step(a: Column, s: Column) -> Column:
        return F.when(F.exists(a, lambda o: (o["first"] < s["last"]) & (s["first"] < o["last"])), a).otherwise(
            F.concat(a, F.array(s)))
    lean = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last")))
    return F.aggregate(lean, held, step)


def _added(every: DataFrame):
    """(the loose candidates that the trees select, report), or None."""
    flat = every.select("doc_id", "th", F.explode("spans").alias("s")).select("doc_id", "th", "s.*").distinct()
    loose = materialize(labelled(flat), "pii-loose")
    fitted = fit(loose.filter("label IS NOT NULL"))
    if fitted is None:
        return None
    model, cut, report = fitted
    floor = F.lit(2.0)
    for k, p in cut.items():
        floor = F.when(F.col("kind") == k, F.lit(float(p))).otherwise(floor)
    scored = model.transform(_features(loose.filter("able"))).withColumn("p", vector_to_array("probability")[1])
    return scored.filter(F.col("p") >= floor), report


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, n_held, precision, recall, n_added): the thresholds on the candidates held back, and the spans they add to the
    strict ones."""
    schema = "kind string, n_held int, precision double, recall double"
    out = _added(materialize(candidates(docs, doc_id, text), "pii-candidates"))
    if out is None:
        return docs.sparkSession.createDataFrame([(k, 0, None, None) for k in ALL], schema).withColumn("n_added", F.lit(0).cast("long"))
    n = F.size(F.filter("spans", lambda s: s["kind"] == F.col("kind"))) - F.size(F.filter("base", lambda s: s["kind"] == F.col("kind")))
    found = find(docs, doc_id, text).select("base", "spans", F.explode(F.array(*[F.lit(k) for k in ALL])).alias("kind"))
    counts = found.groupBy("kind").agg(F.sum(n).alias("n_added"))
    return docs.sparkSession.createDataFrame(out[1], schema).join(counts, "kind", "left")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, base, spans) for every row: ``base`` the strict spans, ``spans``
    all, as arrays of (kind, first, last) in the order of ALL, then first."""
    every = materialize(candidates(docs, doc_id, text), "pii-candidates")
    rank = F.create_map(*[F.lit(x) for k in enumerate(ALL) for x in (k[1], k[0])])
    strict = F.filter("spans", lambda s: s["strict"] & checked(s))
    based = every.select("doc_id", "th", F.transform(strict, lambda s: F.struct(
        s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"))).alias("base"))
    found = _added(every)
    if found is None:
        return based.withColumn("spans", F.col("base"))
    added = found[0].groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("p")).alias("p"), "first", (-F.col("last")).alias("end"), "kind", "last"))).alias("extra"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "extra")
    met = based.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(_apart(F.col("extra"), F.col("base")))
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(
        F.element_at(rank, s["kind"]).alias("rank"), s["first"].alias("first"), s["last"].alias("last"),
        s["kind"].alias("kind"))))
    return met.select("doc_id", "th", "base", F.transform(keyed, lambda s: F.struct(
        s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"))).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``redacted``: each span replaced by its kind in angle brackets;
    overlapping spans go together, under the kind of the first."""
    docs = without(docs, "redacted", "_id", "_th", "_spans")
    spans = find(docs, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"),
                                            F.col("spans").alias("_spans")).distinct()
    met = docs.join(spans, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_th")), "left")
    t = F.coalesce(F.col(text), F.lit(""))
    ordered = F.sort_array(F.transform("_spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"),
                                                                    s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        grown = F.struct(F.greatest(a["at"], s["last"]).alias("at"), a["out"].alias("out"))
        return F.when(s["first"] < a["at"], grown).otherwise(F.struct(
            s["last"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["first"] - a["at"]), F.lit("<"),
                                            s["kind"], F.lit(">")).alias("out")))

    done = F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))))
    return met.select(*[F.col(c) for c in docs.columns], F.coalesce(done, t).alias("redacted"))
