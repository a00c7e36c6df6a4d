import re
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.llm import common, secrets

VALUE = "Zx9/q+Lw_77.=-"
KEYWORDS = r"[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
PLAIN = [("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
TEXTS = [
    None,
    "",
    "token",
    f"API_Key = '{VALUE}' and pAsSwD:{VALUE}",
    f"secret: token: {VALUE}",  # the base match ends in 'token', which is short
    f"ſecret = {VALUE} toKen={VALUE}",  # letters outside ASCII are no case variants
    "é😀" + "0123456789abcdef" + "😀 x" + "f" * 15 + "  " + "a" * 40,
    "AKIA" + "A" * 13 + " AKIA" + "B" * 14 + "c AKIAAKIA" + "9" * 10,
    f'token="{"0af" * 9}"',
    "-----BEGIN RSA PRIVATE KEY-----",
    " ".join(f"{'ab12' * 4} token = short" for _ in range(700)) + " é secret=" + "k" * 30,
]


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, pattern, group, least) in enumerate(PLAIN) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in sorted(found))


def folder(spark):
    return common.fresh_dir(spark, f"test-ledger-{uuid.uuid4().hex[:6]}")


def base(rows):
    return rows.withColumn("base", secrets.written(F.filter("findings", lambda f: f["place"] < 3)))


def test_spans_are_brute_force_s(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, TEXTS[3]), (99, TEXTS[3]), (None, TEXTS[3])], "doc_id long, text string").repartition(3)
    table = table.withColumn("blob", F.lit("x")).withColumn("findings", F.lit(1)).withColumn("rules", F.lit(2))
    rows = base(secrets.scan(table, folder(spark))).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None and r.doc_id < 99 else TEXTS[3]
        assert r.base == brute(text or ""), r.doc_id
        assert r.rules == 2
    kinds = {r.doc_id: [f.kind for f in r.findings] for r in rows}
    assert kinds[4] == ["nested"] and kinds[9] == ["pem"] and kinds[3] == ["assign", "assign"]


def test_only_unseen_pairs_are_scanned(spark):
    where, table = folder(spark), spark.createDataFrame([(1, f"token={VALUE}"), (2, f"token={VALUE}"), (3, "a" * 20)], "doc_id long, text string")
    batches = lambda: sorted((len(r.rules), len(r.found)) for r in secrets.ledger(spark, where).collect())
    first = secrets.RULES[:1]
    secrets.record(table, where, first)
    assert batches() == [(1, 0), (1, 1)]  # two blobs, one of two paths
    secrets.record(table, where, first)
    assert batches() == [(1, 0), (1, 1)]
    more = table.unionByName(spark.createDataFrame([(4, "b" * 20)], "doc_id long, text string"))
    found = base(secrets.scan(more, where, secrets.BASE)).orderBy("doc_id").collect()
    assert [r.base for r in found] == [brute(f"token={VALUE}")] * 2 + ["hex:0:20"] * 2
    assert batches() == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 1)]  # known blobs: access and hex alone; the new one: all three
    newer = (replace(first[0], version=2, least=99), *secrets.BASE[1:])
    assert [r.base for r in base(secrets.scan(more, where, newer)).orderBy("doc_id").collect()] == ["", "", "hex:0:20", "hex:0:20"]
    assert len(batches()) == 8


def test_blob_of_many_paths_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PART_PATHS", 10)
    table = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit(f"token={VALUE}")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = secrets.scan(table, folder(spark)).collect()
    assert len(rows) == 300 and sum(len(r.findings) == 1 for r in rows) == 200
    where = folder(spark)
    assert secrets.scan(table.where("doc_id < 0"), where).count() == 0 and secrets.ledger(spark, where).count() == 0
