"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed: its blob is the SHA-256 of its text.  The ledger is a folder of
Parquet batches with a row for each blob and batch: (blob, rules, found), where rules names the rule versions that were
scanned and found the spans of those rules, none included.  A scan looks up which rules each blob of the input still
lacks, reads one text of each such blob, appends one batch, and joins the ledger's findings of the current rule
versions back to all paths.  A blob that a third of all paths share is scanned once; equal texts are summed before they
are shuffled, and a blob with many paths is joined in as many parts as its paths need.

Only DataFrame functions: matches are what regexp_extract_all gives, their places follow from the lengths of what
split() leaves between them.  Rules (base ones first):

* assign, access and hex are the base: leftmost matches without overlap, of which those that are too short are
  dropped.
* nested finds an assignment that the base passes over because a shorter, dropped match ends within it
  ("secret: token: ..."): leftmost matches whose value is long enough in itself, without those of assign.
* pem finds the head line of a private key.

Rules of input: null text counts as empty and has no finding; every row gives a row, whatever repeats; other columns are
kept, and names that clash with the operator's own (blob, findings) are replaced; an empty table gives none and adds no
row to the ledger; texts are scanned whole, so that a task holds the longest text a few times; a span counts code points,
from 0, its end excluded.  A batch counts once it is complete, so that a scan that dies adds nothing; two scans that
run at once may scan the same blobs twice, which repeats rows of the ledger and changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER_SCHEMA = f"blob binary, rules array<string>, found {SPANS}"
#: Matches of a text that are placed in one go.
STEPS = 256
#: A blob with more than a thousandth of all paths is joined in parts of so many paths.
PART_PATHS = 10_000


@dataclass(frozen=True)
class Rule:
    """kind and version name a rule; hint is a pattern that every text with a finding matches; least characters of group are kept.

    besides: a rule whose own spans are not found again.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    besides: Rule | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

BASE = (
    Rule("assign", 1, ASSIGN % "+", ASSIGN % "{12}", 2, 12),
    Rule("access", 1, ACCESS, r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, HEX, r"[0-9a-f]{16}", 0, 16),
)
RULES = (*BASE, Rule("nested", 1, ASSIGN % "{12,}", ASSIGN % "{12}", besides=BASE[0]), Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----BEGIN "))


def _run(steps: Column, rule: Rule) -> Column:
    """Struct of the characters that the steps cover and of their spans, counted from the first step's start."""
    at = F.struct(F.lit(0).alias("end"), F.lit(None).cast(SPANS).alias("found"))

    def step(done: Column, s: Column) -> Column:
        start, end = done["end"] + s["gap"], done["end"] + s["gap"] + F.coalesce(s["size"], F.lit(0))
        one = F.array(F.struct(F.lit(rule.name).alias("rule"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("end"), F.when(s["value"] >= rule.least, F.concat(F.coalesce(done["found"], F.array().cast(SPANS)), one)).otherwise(done["found"]).alias("found"))

    return F.aggregate(steps, at, step)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<rule, start, end>> of the rule's matches in text, from left to right; null where the hint finds nothing."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)  # one piece more than matches, as no match is empty
    pairs = F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
    steps = F.zip_with(pairs, value, lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(v).alias("value")))
    # runs of STEPS matches are placed each for itself and then joined, so that a text with very many matches is not copied for each
    firsts = F.sequence(F.lit(1), F.size(steps), F.lit(STEPS))
    runs = F.transform(firsts, lambda i: _run(F.slice(steps, i, F.lit(STEPS)), rule))
    at = F.struct(F.lit(0).alias("end"), F.array().cast(SPANS).alias("found"))

    def join(done: Column, run: Column) -> Column:
        moved = F.transform(run["found"], lambda f: F.struct(f["rule"].alias("rule"), (f["start"] + done["end"]).alias("start"), (f["end"] + done["end"]).alias("end")))
        return F.struct((done["end"] + run["end"]).alias("end"), F.when(run["found"].isNull(), done["found"]).otherwise(F.concat(done["found"], moved)).alias("found"))

    found = F.aggregate(runs, at, join, lambda done: done["found"])
    if rule.besides:
        found = F.array_except(found, spans(text, replace(rule.besides, kind=rule.kind, version=rule.version)))
    return F.when(text.rlike(rule.hint), found)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; none where the folder does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder)


def _unseen(blobs: DataFrame, known: DataFrame, names: Column) -> DataFrame:
    """(blob, rules) of the blobs that lack some of the named rules.  A blob has a row a batch that brought it new rules, so few."""
    seen = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    lacks = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    return lacks.where(F.size("rules") > 0)


def record(rows: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger in folder lacks of the rows' blobs and rules, and append one batch to it."""
    spark, names = rows.sparkSession, F.array(*[F.lit(r.name) for r in rules])
    texts, known = addressed(rows, text_col).select("blob", common.text_of(text_col).alias("text")), ledger(spark, folder)
    if known.isEmpty():
        todo = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", names)
    else:
        lacks = common.cut(_unseen(texts, known, names), "unseen")
        if lacks.isEmpty():
            return
        todo = texts.join(common.maybe_broadcast(lacks, 64 + 24 * len(rules)), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    empty = F.array().cast(SPANS)
    found = F.concat(*[F.coalesce(F.when(F.array_contains("rules", r.name), spans(F.col("text"), r)), empty) for r in rules])
    todo.select("blob", "rules", found.alias("found")).write.mode("append").parquet(folder)


def addressed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with blob, the SHA-256 of the text's UTF-8."""
    return rows.withColumn("blob", F.unhex(F.sha2(common.text_of(text_col), 256)))


def joined_back(rows: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """rows without their text, with blob and findings: array<struct<start, place, kind, end>> by start, then by the rules' order."""
    spark = rows.sparkSession
    paths = common.cut(addressed(rows, text_col).drop(text_col, "findings"), "paths")
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.filter("found", lambda f: place[f["rule"]].isNotNull())
    some = ledger(spark, folder).select("blob", current.alias("found")).where(F.size("found") > 0)
    # scans that ran at once may have left a row twice: a distinct set of spans a blob
    each = some.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    in_order = F.array_sort(F.transform("found", lambda f: F.struct(f["start"].alias("start"), place[f["rule"]].alias("place"), kinds[place[f["rule"]]].alias("kind"), f["end"].alias("end"))))
    findings = each.select("blob", in_order.alias("findings"))
    # a thousand blobs at most have over a thousandth of the paths
    hot = common.cut(paths.groupBy("blob").count().where((F.col("count") > PART_PATHS) & (F.col("count") * 1000 > paths.count())).select("blob", F.ceil(F.col("count") / PART_PATHS).cast("int").alias("parts")), "hot")
    few, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    left = paths.join(few, "blob", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("parts")
    right = findings.join(few, "blob", "left").withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("parts")
    none = F.array().cast(findings.schema["findings"].dataType)
    return left.join(right, ["blob", "part"], "left").drop("part").withColumn("findings", F.coalesce("findings", none))


def scan(rows: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Bring the ledger in folder up to date with the rows' versions and return every row with its findings, see joined_back()."""
    record(rows, folder, rules, text_col)
    return joined_back(rows, folder, rules, text_col)


def written(findings: Column) -> Column:
    """kind:start:end of the findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
