"""Registry of the graph engine's queries over the driver's tables, with their SQL.

Doubles are rounded to 4 places on both sides; counts are BIGINT.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import special
from loomgraph.operators import descent, factor, hierarchy, metrics, moves, objectives, order, sampling, search, selection, spectral, starts
from loomgraph.operators import partition as P
from loomgraph.operators.tiles import tiled
from loomgraph.session import frozen
from loomgraph.sources import adapters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GRAPHS = ("nation_dir", "nation_und", "supply_und")


def views(graph: str) -> str:
    """Common table expressions of a graph: adjacency as counted, block edges, sizes and degrees, totals, all block pairs."""
    adj = "SELECT src, dst, weight FROM e" if graph.endswith("dir") else "SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e"
    return f"""WITH {adapters.SQL[graph]},
adj AS ({adj}),
be AS (SELECT p.block AS r, q.block AS s, sum(weight) AS e FROM adj JOIN part_ p ON src = p.node JOIN part_ q ON dst = q.node GROUP BY ALL),
sz AS (SELECT block, count(*)::DOUBLE AS n FROM part_ GROUP BY block),
bs AS (SELECT sz.block, n, coalesce(o.k, 0) AS ko, coalesce(i.k, 0) AS ki FROM sz LEFT JOIN (SELECT r, sum(e) AS k FROM be GROUP BY r) o ON o.r = block LEFT JOIN (SELECT s, sum(e) AS k FROM be GROUP BY s) i ON i.s = block),
g AS (SELECT (SELECT count(*)::DOUBLE FROM part_) AS nn, (SELECT sum(weight) FROM e) AS ee, (SELECT count(*)::DOUBLE FROM sz) AS b),
pr AS (SELECT a.block AS r, c.block AS s, a.n AS nr, c.n AS ns, a.ko AS kr, c.ki AS ks, coalesce(be.e, 0) AS e FROM bs a CROSS JOIN bs c LEFT JOIN be ON be.r = a.block AND be.s = c.block)
"""


LB = "(CASE WHEN ({1}) >= ({0}) THEN 0 ELSE lgamma(({0}) + 1) - lgamma(({1}) + 1) - lgamma(({0}) - ({1}) + 1) END)"


def _lb(n: str, k: str) -> str:
    return LB.format(n, k)


def _h2(x: str) -> str:
    return f"(CASE WHEN {x} > 0 AND {x} < 1 THEN -({x}) * log2({x}) - (1 - ({x})) * log2(1 - ({x})) ELSE 0 END)"


def _beta(e: str, room: str, a: str) -> str:
    return f"(lgamma({e} + {a}) + lgamma({room} - {e} + {a}) - lgamma({room} + 2 * {a}) - 2 * lgamma({a}))"


#: Numbers of partitions c of m into at most n parts, by running sums in steps of the part that is added; needs WITH RECURSIVE.
COUNTS = """qt AS (SELECT 0 AS n, m::BIGINT AS m, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM range({most}) t(m) UNION ALL
SELECT n + 1, m, sum(c) OVER (PARTITION BY m % (n + 1) ORDER BY m) FROM qt WHERE n < {parts})"""


def _objective_sql(name: str, directed: bool) -> list[str]:
    """Sums whose total is the objective."""
    half, k = ("1.0", "ko + ki") if directed else ("0.5", "ko")
    free = "b * b" if directed else "b * (b + 1) / 2"
    prior = [f"SELECT -{_lb(f'{free} + ee - 1', 'ee')} - lgamma(nn + 1) - {_lb('nn - 1', 'b - 1')} - ln(nn) FROM g", "SELECT sum(lgamma(n + 1)) FROM bs"]
    arranged = ["SELECT sum(lgamma(e + 1)) FROM be"] if directed else ["SELECT coalesce(sum(lgamma(e + 1)), 0) FROM be WHERE r < s", "SELECT coalesce(sum(ln(2) * e / 2 + lgamma(e / 2 + 1)), 0) FROM be WHERE r = s"]
    pair = "src, dst" if directed else "least(src, dst), greatest(src, dst)"
    loop = "0" if directed else "CASE WHEN i = j THEN ln(2) * a ELSE 0 END"
    adjacency = [f"SELECT sum(-lgamma(a + 1) - {loop}) FROM (SELECT i, j, sum(weight) AS a FROM (SELECT {pair.split(', ', 1)[0] if directed else 'least(src, dst)'} AS i, {'dst' if directed else 'greatest(src, dst)'} AS j, weight FROM e) GROUP BY i, j)"]
    if directed:
        degrees = [f"SELECT sum(lgamma(k + 1)) FROM (SELECT sum(weight) AS k FROM e GROUP BY {c})" for c in ("src", "dst")]
        ends = ["SELECT -sum(lgamma(ko + 1) + lgamma(ki + 1)) FROM bs"]
        uniform = [f"SELECT -sum({_lb('n + ki - 1', 'ki')} + {_lb('n + ko - 1', 'ko')}) FROM bs"]
    else:
        degrees = ["SELECT sum(lgamma(k + 1)) FROM (SELECT sum(weight) AS k FROM adj GROUP BY src)"]
        ends = ["SELECT -sum(lgamma(ko + 1)) FROM bs"]
        uniform = [f"SELECT -sum({_lb('n + ko - 1', 'ko')}) FROM bs"]
    if name == "skn":
        return ["SELECT sum(e * ln(e / (nr * ns))) FROM pr WHERE e > 0"]
    if name == "dckn":
        return ["SELECT sum(e * ln(e / (kr * ks))) FROM pr WHERE e > 0"]
    if name == "sps":
        return [f"SELECT -sum(({k}) * ln(n)) FROM bs", f"SELECT {half} * sum(e * ln(e)) FROM be"]
    if name == "spd":
        return [f"SELECT -{half} * sum(e * {_h2('(e / (nr * ns))')}) FROM pr WHERE e > 0"]
    if name == "dcp":
        return [f"SELECT {half} * sum(e * ln(e / (kr * ks))) FROM pr WHERE e > 0"]
    if name in ("iclexj", "iclexu"):
        a = "0.5" if name == "iclexj" else "1.0"
        pairs = [f"SELECT sum({_beta('e', 'nr * ns', a)}) FROM pr"] if directed else [f"SELECT sum({_beta('e', 'nr * ns', a)}) FROM pr WHERE r < s", f"SELECT sum({_beta('e / 2', 'nr * (nr + 1) / 2', a)}) FROM pr WHERE r = s"]
        return [*pairs, f"SELECT sum(lgamma(n + {a}) - lgamma({a})) FROM bs", f"SELECT lgamma({a} * b) - lgamma({a} * b + nn) FROM g"]
    if name in ("snr", "dcnr"):
        p = "(SELECT ee / (nn * nn) FROM g)" if directed else "(SELECT 2 * ee / (nn * nn) FROM g)"
        pairs = [f"SELECT sum(lgamma(e + 1) - (e + 1) * ln({p} * nr * ns + 1)) FROM pr" + ("" if directed else " WHERE r < s")]
        if not directed:
            pairs.append(f"SELECT sum(lgamma(e + 1) - (e + 1) * ln(0.5 * {p} * nr * nr + 1)) FROM pr WHERE r = s")
        extra = [f"SELECT sum(({k}) * ln(n) + lgamma(n) - lgamma(n + {k})) FROM bs"] if name == "dcnr" else []
        return [*pairs, *extra, "SELECT -ln(nn) + lgamma(b) - lgamma(nn + b) FROM g", "SELECT sum(lgamma(n + 1)) FROM bs"]
    if name == "dcpuh":
        lq = [f"SELECT -sum(ln(c)) FROM bs JOIN qt ON qt.n = bs.n AND qt.m = {k}" for k in (("ko", "ki") if directed else ("ko",))]
        kinds = "SELECT sum(lgamma(c + 1)) FROM (SELECT block, o, i, count(*)::DOUBLE AS c FROM dg JOIN part_ USING (node) GROUP BY block, o, i)"
        return [*degrees, *adjacency, *ends, *arranged, *lq, "SELECT -sum(lgamma(n + 1)) FROM bs", kinds, *prior]
    if name == "spc":
        return [*arranged, f"SELECT -sum(({k}) * ln(n)) FROM bs", *adjacency, *prior]
    return [*degrees, *adjacency, *ends, *arranged, *uniform, *prior]


def _with_counts(sql: str, most: str, parts: str) -> str:
    """views() with the numbers of partitions and the degrees."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + COUNTS.format(most=most, parts=parts) + """,
dg AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, weight AS o, 0.0 AS i FROM adj UNION ALL SELECT dst, 0.0, weight FROM adj UNION ALL SELECT node, 0.0, 0.0 FROM part_) GROUP BY node)
"""


def _simple(sql: str) -> str:
    """views() of the graph without multiplicities."""
    return sql.replace("WITH e AS (", "WITH e0 AS (", 1).replace(",\nadj AS", ",\ne AS (SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM e0),\nadj AS", 1)


def _total(parts: list[str], column: str = "objective") -> str:
    return "SELECT round(" + " + ".join(f"({p})" for p in parts) + f" + 0.0, 4) AS {column}"


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _rounded(df: DataFrame, column: str = "objective") -> DataFrame:
    return df.select(F.round(column, 4).alias(column))


def _register_objectives() -> None:
    for graph in GRAPHS:
        for name, f in objectives.OBJECTIVES.items():
            # the exact integrated likelihood is for simple graphs: multiplicities drop out
            simple = name.startswith("iclex") or name == "spd"
            def run(spark, sf_dir, graph=graph, f=f, simple=simple):
                own, part = adapters.GRAPHS[graph](spark, sf_dir)
                return _rounded(f(objectives.Blocks(own.collapsed() if simple else own, part)))

            sql = _simple(views(graph)) if simple else views(graph)
            if name == "dcpuh":
                sql = _with_counts(sql, "(SELECT max(greatest(ko, ki)) + 1 FROM bs)::BIGINT", "(SELECT max(n) FROM bs)")
            _add(f"{name}_{graph}", run, sql + _total(_objective_sql(name, graph.endswith("dir"))))


def _register_views() -> None:
    for graph in GRAPHS:
        directed = graph.endswith("dir")

        def on(f, graph=graph):
            return lambda spark, sf_dir: f(*adapters.GRAPHS[graph](spark, sf_dir))

        v = views(graph)
        ends = "SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e" if directed else "SELECT src AS node, weight FROM adj"
        deg = f"(SELECT node, coalesce(sum(weight), 0) AS degree FROM (SELECT node, weight FROM ({ends}) UNION ALL SELECT node, 0.0 FROM part_) GROUP BY node)"
        io = "(SELECT node, sum(i) AS din, sum(o) AS dout FROM (SELECT src AS node, 0.0 AS i, weight AS o FROM adj UNION ALL SELECT dst, weight, 0.0 FROM adj UNION ALL SELECT node, 0.0, 0.0 FROM part_) GROUP BY node)"
        _add(f"degree_{graph}", on(lambda g, p: g.degrees()), v + f"SELECT node, degree FROM {deg}")
        _add(f"in_out_degree_{graph}", on(lambda g, p: g.in_out_degrees()), v + f"SELECT node, din::DOUBLE AS din, dout::DOUBLE AS dout FROM {io}")
        _add(f"isolated_{graph}", on(lambda g, p: g.isolated()), v + "SELECT node FROM part_ WHERE node NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
        _add(f"neighbours_{graph}", on(lambda g, p: g.neighbours().groupBy("node").agg(F.count("*").alias("n"))), v + "SELECT node, count(*) AS n FROM (SELECT src AS node, dst AS other FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst) GROUP BY node")
        _add(f"adj_matrix_{graph}", on(lambda g, p: g.adj_matrix().groupBy("src").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))), v + "SELECT src, count(*) AS n, sum(w) AS w FROM (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY src, dst) GROUP BY src")
        _add(f"block_sizes_{graph}", on(lambda g, p: P.block_sizes(p)), v + "SELECT block, n::BIGINT AS n FROM sz")
        _add(f"block_edges_{graph}", on(P.block_edges), v + "SELECT r, s, e FROM be")
        _add(f"block_stats_{graph}", on(P.block_stats), v + "SELECT block, n, ko AS k_out, ki AS k_in FROM bs")
        cov = "SELECT p.block AS r, q.block AS s, covariate AS c FROM e JOIN part_ p ON src = p.node JOIN part_ q ON dst = q.node"
        _add(f"covariate_sums_{graph}", on(P.covariate_sums), v + f"SELECT r, s, sum(c) AS cov FROM ({cov}" + ("" if directed else f" UNION ALL SELECT s, r, c FROM ({cov}) WHERE r <> s") + ") GROUP BY r, s")
        _add(f"move_context_{graph}", on(P.move_context), v + "SELECT node, block, sum(o) AS k_out, sum(i) AS k_in FROM (SELECT src AS node, dst AS other, weight AS o, 0.0::DOUBLE AS i FROM adj WHERE src <> dst UNION ALL SELECT dst, src, 0.0, weight FROM adj WHERE src <> dst) m JOIN part_ USING (node) JOIN (SELECT node AS other, block AS ob FROM part_) o USING (other) GROUP BY ALL".replace("SELECT node, block, sum(o)", "SELECT m.node, ob AS block, sum(o)").replace(" JOIN part_ USING (node)", "").replace("GROUP BY ALL", "GROUP BY m.node, ob"))
        _add(f"self_loops_{graph}", on(lambda g, p: P.self_loops(g)), v + "SELECT src AS node, sum(weight) AS loops FROM e WHERE src = dst GROUP BY src")
        _add(f"degree_counts_{graph}", on(P.degree_distribution), v + f"SELECT block, degree, count(*) AS n FROM {deg} JOIN part_ USING (node) GROUP BY block, degree")
        _add(f"degree_shares_{graph}", on(lambda g, p: P.degree_distribution(g, p, True).withColumn("p", F.round("p", 6))), v + f"SELECT block, degree, round(count(*) / sum(count(*)) OVER (PARTITION BY block), 6) AS p FROM {deg} JOIN part_ USING (node) GROUP BY block, degree")
        _add(f"joint_degree_counts_{graph}", on(P.joint_degree_distribution), v + f"SELECT block, din::DOUBLE AS din, dout::DOUBLE AS dout, count(*) AS n FROM {io} JOIN part_ USING (node) GROUP BY ALL")
        _add(f"neighbour_blocks_{graph}", on(lambda g, p: P.neighbour_blocks(P.block_edges(g, p))), v + "SELECT r AS block, s AS other FROM be WHERE r <> s UNION SELECT s, r FROM be WHERE r <> s")
        q = "p.block, q.block" if directed else "least(p.block, q.block), greatest(p.block, q.block)"
        q1, q2 = q.split("block, ", 1)[0] + "block" if directed else "least(p.block, q.block)", "q.block" if directed else "greatest(p.block, q.block)"
        _add(f"quotient_{graph}", on(lambda g, p: P.quotient(g, p).edges), v + f"SELECT src, dst, sum(weight) AS weight FROM (SELECT {q1} AS src, {q2} AS dst, weight FROM e JOIN part_ p ON e.src = p.node JOIN part_ q ON e.dst = q.node) GROUP BY src, dst")
        _add(f"merge_{graph}", on(lambda g, p: P.block_edges(g, P.merge(p, p.sparkSession.createDataFrame([(1, 0), (3, 2)], "block int, into int")))), v + "SELECT p.b AS r, q.b AS s, sum(weight) AS e FROM adj JOIN (SELECT node, CASE block WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE block END AS b FROM part_) p ON src = p.node JOIN (SELECT node, CASE block WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE block END AS b FROM part_) q ON dst = q.node GROUP BY ALL")

        def zoomed(g, p):
            above = p.select(F.col("block").alias("node"), F.pmod("block", F.lit(2)).cast("int").alias("block")).distinct()
            return P.zoom(p, above).groupBy("block").agg(F.count("*").alias("n"))

        _add(f"zoom_{graph}", on(zoomed), v + "SELECT (block % 2)::INT AS block, count(*) AS n FROM part_ GROUP BY ALL")
        _add(f"relabel_{graph}", on(lambda g, p: P.block_sizes(P.relabelled(p))), v + "SELECT (row_number() OVER (ORDER BY block) - 1)::INT AS block, n::BIGINT AS n FROM sz")
        if not directed:
            _add(f"modularity_{graph}", on(lambda g, p: metrics.modularity(g, p).select(F.round("q", 8).alias("q"))), v + "SELECT round(sum(coalesce(e, 0) / m - (ko / m) * (ko / m)), 8) AS q FROM bs LEFT JOIN (SELECT r, e FROM be WHERE r = s) ON r = block CROSS JOIN (SELECT sum(e) AS m FROM be)")
            _add(f"modularity_by_block_{graph}", on(lambda g, p: metrics.modularity_by_block(g, p).withColumn("q", F.round("q", 8))), v + "SELECT block, round(coalesce(e, 0) / m - (ko / m) * (ko / m), 8) AS q FROM bs LEFT JOIN (SELECT r, e FROM be WHERE r = s) ON r = block CROSS JOIN (SELECT sum(e) AS m FROM be)")


def _register_selection() -> None:
    for graph in GRAPHS:
        directed = graph.endswith("dir")
        free, v = "b * b" if directed else "b * (b + 1) / 2", views(graph)
        h = f"({free} / ee)"
        sql = {
            "aic": f"SELECT {free} + b FROM g",
            "bic": f"SELECT 0.5 * {free} * 2 * ln(nn) FROM g",
            "bic_sparse": f"SELECT 0.5 * {free} * 3 * ln(nn) FROM g",
            "icl": "SELECT (b - 1) / 2 * ln(nn) + b * b / 2 * ln(nn * nn) FROM g" if directed else "SELECT (b - 1) / 2 * ln(nn) + b * (b + 1) / 4 * ln(nn * (nn - 1) / 2) FROM g",
            "mdl": f"SELECT {_lb('b + nn - 1', 'nn')} + {_lb(f'{free} + ee - 1', 'ee')} - (SELECT sum(lgamma(n + 1)) FROM bs) FROM g",
            "mdl_traditional": f"SELECT ee * ln(b) + {free} * ln(ee) FROM g",
            "mdl_first": f"SELECT ee * ((1 + {h}) * ln(1 + {h}) - {h} * ln({h})) + nn * ln(b) FROM g",
        }
        tables = ["src", "dst"] if directed else ["src"]
        entropy = " + ".join(f"(SELECT sum(m * ln(m / n)) FROM (SELECT block, k, count(*)::DOUBLE AS m FROM (SELECT node, block, coalesce(sum(weight), 0) AS k FROM part_ LEFT JOIN adj ON adj.{c} = node GROUP BY node, block) GROUP BY block, k) JOIN bs USING (block))" for c in tables)
        sql["mdl_corrected"] = f"SELECT ({sql['mdl']}) - ({entropy})"
        for name, f in selection.PENALTIES.items():
            def run(spark, sf_dir, graph=graph, f=f):
                return _rounded(f(objectives.Blocks(*adapters.GRAPHS[graph](spark, sf_dir))))

            _add(f"{name}_{graph}", run, v + _total([sql[name]]))

    def chosen(spark, sf_dir):
        """The best number of blocks among the regions merged step by step, by skn less bic."""
        graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
        graph, rows = graph.counted(), None
        for k in range(1, 6):
            own = objectives.Blocks(graph, part.select("node", F.least("block", F.lit(k - 1)).alias("block")))
            one = objectives.skn(own).withColumnRenamed("objective", "o").withColumn("blocks", F.lit(k)).join(F.broadcast(selection.bic(own).withColumnRenamed("objective", "penalty")), F.lit(True))
            one = one.select("blocks", F.col("o").alias("objective"), "penalty")
            rows = one if rows is None else rows.unionByName(one)
        return selection.select(rows).select(F.col("blocks").cast("int").alias("blocks"), F.round("score", 4).alias("score"))

    each = []
    for k in range(1, 6):
        each.append(
            f"SELECT {k}::INT AS blocks, (SELECT sum(e * ln(e / (a.n * c.n))) FROM (SELECT least(r, {k - 1}) AS r, least(s, {k - 1}) AS s, sum(e) AS e FROM be GROUP BY ALL) x JOIN (SELECT least(block, {k - 1}) AS block, sum(n) AS n FROM sz GROUP BY ALL) a ON a.block = x.r JOIN (SELECT least(block, {k - 1}) AS block, sum(n) AS n FROM sz GROUP BY ALL) c ON c.block = x.s) - {k * (k + 1) / 2} * ln((SELECT nn FROM g)) AS score"
        )
    _add("select_nation_und", chosen, views("nation_und") + "SELECT blocks, round(score, 4) AS score FROM (" + " UNION ALL ".join(each) + ") ORDER BY score DESC, blocks LIMIT 1")


def _register_metrics() -> None:
    both = """WITH t AS (SELECT c_mktsegment AS x, n_regionkey AS y, count(*)::DOUBLE AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
i AS (SELECT (SELECT sum(n) FROM t) AS n, (SELECT ln(sum(m)) - sum(m * ln(m)) / sum(m) FROM (SELECT sum(n) AS m FROM t GROUP BY x)) AS hx, (SELECT ln(sum(m)) - sum(m * ln(m)) / sum(m) FROM (SELECT sum(n) AS m FROM t GROUP BY y)) AS hy, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM t) AS hxy)
"""
    labels = adapters.customer_labels
    _add("contingency_customers", lambda s, d: metrics.contingency(*labels(s, d)), both + "SELECT x, y, n::BIGINT AS n FROM t")
    _add("entropy_segments", lambda s, d: metrics.entropy(labels(s, d)[0]).select(F.round("h", 8).alias("h")), both + "SELECT round(hx, 8) AS h FROM i")
    _add("mutual_information_customers", lambda s, d: metrics.information(metrics.contingency(*labels(s, d))).select(*(F.round(c, 8).alias(c) for c in ("hx", "hy", "i"))), both + "SELECT round(hx, 8) AS hx, round(hy, 8) AS hy, round(hx + hy - hxy, 8) AS i FROM i")
    for kind, of in (("sqrt", "sqrt(hx * hy)"), ("arithmetic", "((hx + hy) / 2)"), ("max", "greatest(hx, hy)")):
        _add(f"nmi_{kind}_customers", lambda s, d, kind=kind: metrics.nmi(*labels(s, d), kind).select(F.round("nmi", 8).alias("nmi")), both + f"SELECT round((hx + hy - hxy) / {of}, 8) AS nmi FROM i")
    expected = """, m AS (SELECT x, sum(n) AS a FROM t GROUP BY x), o AS (SELECT y, sum(n) AS b FROM t GROUP BY y),
k AS (SELECT a, b, i.n, unnest(range(greatest(1, a + b - i.n)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM m, o, i),
em AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e FROM k)
"""
    for kind, of in (("arithmetic", "(hx + hy) / 2"), ("max", "greatest(hx, hy)")):
        _add(f"ami_{kind}_customers", lambda s, d, kind=kind: metrics.ami(*labels(s, d), kind).select(F.round("ami", 6).alias("ami")), both + expected + f"SELECT round((hx + hy - hxy - e) / ({of} - e), 6) + 0.0 AS ami FROM i, em")
    runs = "SELECT l_returnflag AS algo, l_quantity AS q, l_discount AS d FROM lineitem"

    def table(s, d):
        return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("algo"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))

    _add("summary_mean_std", lambda s, d: metrics.summary(table(s, d), ["algo"], ["q", "d"]), f"SELECT algo, round(avg(q), 4) AS q_mean, round(stddev_samp(q), 4) AS q_std, round(avg(d), 4) AS d_mean, round(stddev_samp(d), 4) AS d_std FROM ({runs}) GROUP BY algo")
    _add("success_rate", lambda s, d: metrics.success_rate(table(s, d), ["algo"], "q", 25.0).withColumn("success_rate", F.round("success_rate", 6)), f"SELECT algo, round(avg(CASE WHEN q >= 25 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM ({runs}) GROUP BY algo")


def _moved_sql(name: str, graph: str, moves: str, keys: str) -> str:
    """The full objective of the partition after each of the moves(mv, keys, fb, tb), less the one before; a move takes the nodes for which its condition holds from block fb to tb."""
    directed, dcpuh = graph.endswith("dir"), name == "dcpuh"
    base = _simple(views(graph)) if name.startswith("iclex") or name == "spd" else views(graph)
    if dcpuh:
        base = _with_counts(base, "(SELECT 2 * ee + 1 FROM g)::BIGINT", "(SELECT nn FROM g)")
    before, after = [], []
    for part in _objective_sql(name, directed):
        found = re.fullmatch(r"SELECT (.*) FROM (pr|be|bs|g)( JOIN qt .*| WHERE .*)?", part, re.S)
        if found:
            value, table, rest = found.groups()
            before.append(part)
            after.append(f"SELECT mv, {value} AS v FROM {table}_m" if table == "g" else f"SELECT mv, {value} AS v FROM {table}_m {(rest or '').replace('bs.n', 'bs_m.n')} GROUP BY mv")
        elif "dg JOIN part_" in part:
            before.append(part)
            after.append("SELECT mv, sum(lgamma(c + 1)) AS v FROM (SELECT mv, block, o, i, count(*)::DOUBLE AS c FROM dg JOIN np USING (node) GROUP BY mv, block, o, i) GROUP BY mv")
    return base + f""",
{moves},
be_m AS (SELECT p.mv, p.block AS r, q.block AS s, sum(weight) AS e FROM adj JOIN np p ON src = p.node JOIN np q ON dst = q.node AND q.mv = p.mv GROUP BY ALL),
sz_m AS (SELECT mv, block, count(*)::DOUBLE AS n FROM np GROUP BY mv, block),
bs_m AS (SELECT z.mv, z.block, n, coalesce(o.k, 0) AS ko, coalesce(i.k, 0) AS ki FROM sz_m z LEFT JOIN (SELECT mv, r, sum(e) AS k FROM be_m GROUP BY mv, r) o ON o.mv = z.mv AND o.r = block LEFT JOIN (SELECT mv, s, sum(e) AS k FROM be_m GROUP BY mv, s) i ON i.mv = z.mv AND i.s = block),
g_m AS (SELECT mv, nn, ee, count(*)::DOUBLE AS b FROM sz_m CROSS JOIN (SELECT nn, ee FROM g) GROUP BY mv, nn, ee),
pr_m AS (SELECT a.mv, a.block AS r, c.block AS s, a.n AS nr, c.n AS ns, a.ko AS kr, c.ki AS ks, coalesce(x.e, 0) AS e FROM bs_m a JOIN bs_m c ON a.mv = c.mv LEFT JOIN be_m x ON x.mv = a.mv AND x.r = a.block AND x.s = c.block),
d AS (SELECT mv, sum(v) - ({' + '.join(f'({p})' for p in before)}) AS delta FROM ({' UNION ALL '.join(after)}) GROUP BY mv)
SELECT {keys}, round(delta, 4) + 0.0 AS delta FROM mv JOIN d USING (mv)"""


_NP = "np AS (SELECT mv, p.node, CASE WHEN {moves} THEN tb ELSE p.block END AS block FROM mv CROSS JOIN part_ p)"
#: The moves of node_deltas() to all blocks, to blocks of their own, and of merge_deltas().
_MOVES = {
    "delta": ("mv AS (SELECT row_number() OVER () AS mv, p.node AS m, p.block AS fb, c.block AS tb FROM part_ p JOIN sz c ON c.block <> p.block),\n" + _NP.format(moves="p.node = m"), "m AS node, fb AS from_block, tb AS to_block"),
    "delta_new": ("mv AS (SELECT row_number() OVER () AS mv, node AS m, block AS fb, 1000000 AS tb FROM part_),\n" + _NP.format(moves="p.node = m"), "m AS node, fb AS from_block"),
    "delta_merge": ("mv AS (SELECT row_number() OVER () AS mv, a.block AS fb, c.block AS tb FROM sz a JOIN sz c ON c.block <> a.block),\n" + _NP.format(moves="p.block = fb"), 'fb AS block, tb AS "into"'),
}


def _register_moves() -> None:
    def on(graph: str, name: str, kind: str):
        def run(spark, sf_dir):
            own, part = adapters.GRAPHS[graph](spark, sf_dir)
            own = own.collapsed() if name.startswith("iclex") or name == "spd" else own
            if kind == "delta_merge":
                found = objectives.merge_deltas(own, part, name)
            else:
                found = objectives.node_deltas(own, part, name, "new" if kind == "delta_new" else "all")
            return found.withColumn("delta", F.round("delta", 4) + 0.0).drop(*(["to_block"] if kind == "delta_new" else []))

        return run

    for graph in ("nation_und", "nation_dir"):
        for name in objectives.OBJECTIVES:
            for kind, (moves, keys) in _MOVES.items():
                if (kind, graph) in (("delta_new", "nation_und"), ("delta_merge", "nation_dir")):
                    continue
                _add(f"{kind}_{name}_{graph}", on(graph, name, kind), _moved_sql(name, graph, moves, keys))

    for name in ("skn", "dckn"):
        def best(spark, sf_dir, name=name):
            graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
            return objectives.best_moves(objectives.node_deltas(graph, part, name)).select("node", "from_block", "to_block", F.round("delta", 4).alias("delta"))

        inner = _moved_sql(name, "nation_und", *_MOVES["delta"]).replace("round(delta, 4) + 0.0 AS delta FROM mv", "delta FROM mv")
        at = inner.rindex("SELECT m AS node")
        ranked = f"{inner[:at]}SELECT node, from_block, to_block, delta FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(delta, 9) DESC, to_block) AS rn FROM ({inner[at:]})) WHERE rn = 1 AND delta > 0.001"
        _add(f"best_moves_{name}_nation_und", best, f"{ranked[:at]}SELECT node, from_block, to_block, round(delta, 4) AS delta FROM ({ranked[at:]})")

        def em_once(spark, sf_dir, name=name):
            graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
            return search.em_step(graph, part, name)

        leaving = "SELECT from_block, count(*) AS k, max(node) AS last FROM bm GROUP BY from_block"
        step = f"SELECT p.node, coalesce(to_block, block)::INT AS block FROM part_ p LEFT JOIN (SELECT bm.node, bm.to_block FROM bm JOIN ({leaving}) l ON l.from_block = bm.from_block JOIN sz ON sz.block = bm.from_block WHERE k < n OR node < last) k ON k.node = p.node"
        _add("em_step_nation_und" if name == "dckn" else f"em_step_{name}_nation_und", em_once, f"{ranked[:at].rstrip()},\nbm AS ({ranked[at:]})\n{step}")


def _register_factor() -> None:
    def weights(part):
        """A factor from the partition: every node has weight 1 / sqrt of its block's size."""
        sizes = P.block_sizes(part)
        return part.join(sizes, "block").select("node", F.col("block").alias("v"), (1 / F.sqrt("n")).alias("w"))

    for graph in ("nation_und", "supply_und"):
        def s_matrix(spark, sf_dir, graph=graph):
            own, part = adapters.GRAPHS[graph](spark, sf_dir)
            return factor.s_matrix(own.counted().adj_matrix(), weights(part)).withColumn("val", F.round("val", 4))

        def error(spark, sf_dir, graph=graph):
            own, part = adapters.GRAPHS[graph](spark, sf_dir)
            x = frozen(own.counted().adj_matrix(), "matrix")
            return factor.relative_error(x, factor.s_matrix(x, weights(part))).select(F.round("error", 8).alias("error"))

        def assigned(spark, sf_dir, graph=graph):
            own, part = adapters.GRAPHS[graph](spark, sf_dir)
            x = frozen(own.adj_matrix(), "matrix")
            tiles = tiled(x)
            columns = frozen(factor.block_means(x, part, tiles), "means")
            return factor.assign(x, columns, tiles).select("node", "v", F.round("w", 6).alias("w"))

        mat = views(graph) + """,
x AS (SELECT src, dst, sum(weight) AS x FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY ALL),
z AS (SELECT node, block AS v, 1 / sqrt(n) AS w FROM part_ JOIN sz USING (block)),
sm AS (SELECT a.v AS k, b.v AS l, sum(a.w * x * b.w) AS val FROM x JOIN z a ON src = a.node JOIN z b ON dst = b.node GROUP BY ALL)
"""
        _add(f"s_matrix_{graph}", s_matrix, mat + "SELECT k, l, round(val, 4) AS val FROM sm")
        _add(f"factor_error_{graph}", error, mat + "SELECT round(sqrt(greatest(0, (SELECT sum(x * x) FROM x) - (SELECT sum(val * val) FROM sm))) / sqrt((SELECT sum(x * x) FROM x)), 8) AS error")
        _add(
            f"orth_assign_{graph}",
            assigned,
            mat
            + """, u AS (SELECT src AS node, block AS v, sum(x) / any_value(n) AS u FROM x JOIN part_ ON dst = part_.node JOIN sz USING (block) GROUP BY ALL),
nu AS (SELECT v, sum(u * u) AS q FROM u GROUP BY v), nx AS (SELECT src, sqrt(sum(x * x)) AS q FROM x GROUP BY src),
c AS (SELECT x.src AS node, u.v, sum(x * u) AS ip FROM x JOIN u ON u.node = x.dst GROUP BY ALL),
rk AS (SELECT c.node, c.v, ip / nu.q AS w, row_number() OVER (PARTITION BY c.node ORDER BY round(ip / sqrt(nu.q) / nx.q, 9) DESC, c.v) AS rn FROM c JOIN nu USING (v) JOIN nx ON nx.src = c.node)
SELECT node, v, round(w, 6) AS w FROM rk WHERE rn = 1""",
        )


def _register_searches() -> None:
    """Order-dependent searches: no SQL; a row per node of the best of two trials."""
    for method in ("ma", "mha_1k", "mhac_1k", "mhab_1k", "kl_g", "kl_g_nn", "kl_em", "kl", "kl_nn", "pah", "spectral", "spectral_norm", "frost", "svca"):
        def run(spark, sf_dir, method=method):
            graph, _ = adapters.GRAPHS["nation_und"](spark, sf_dir)
            edges = graph.edges.select(F.lit("nation").alias("graph_id"), "src", "dst", "weight")
            runs = search.search(edges, search.grid_of(spark, [method], ["dckn"], [5], 2), False, seed=1)
            return search.best_trials(runs).select("method", "trial", "node", "block", F.round("value", 4).alias("value"), "status")

        _add(f"search_{method}_nation_und", run, None)



def _register_more_searches() -> None:
    def hierarchy(spark, sf_dir):
        graph, _ = adapters.GRAPHS["nation_und"](spark, sf_dir)
        edges = graph.edges.select(F.lit("nation").alias("graph_id"), "src", "dst", "weight")
        return search.hierarchies(edges, False, seed=1).select("level", "node", "block", F.round("value", 4).alias("value"))

    _add("search_hierarchical_nation_und", hierarchy, None)

    def from_regions(spark, sf_dir):
        graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
        edges = graph.edges.select(F.lit("nation").alias("graph_id"), "src", "dst", "weight")
        runs = search.search(edges, search.grid_of(spark, ["kl_g_nn"], ["dckn"], [5], 1), False, seed=1, given=part.withColumn("graph_id", F.lit("nation")))
        return runs.select("method", "node", "block", F.round("value", 4).alias("value"), "status")

    _add("search_from_regions_nation_und", from_regions, None)


#: Matrix x(src, dst, x) of a graph, after views().
_MATRIX = """,
x AS (SELECT src, dst, sum(weight) AS x FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY ALL)"""


def _register_order() -> None:
    """Ranks, running sums and the best prefix of line items by price, ship date and key; the value is what a quantity has above 25.5."""
    by = ("price_down", "l_shipdate", "l_orderkey", "l_linenumber")
    columns, sql = ("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE - 25.5 AS v, row_number() OVER o - 1 AS idx, sum(l_quantity::DOUBLE - 25.5) OVER (o ROWS UNBOUNDED PRECEDING) AS running FROM lineitem WINDOW o AS (ORDER BY l_extendedprice DESC, l_shipdate, l_orderkey, l_linenumber)"

    def lines(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns, "l_shipdate", (-F.col("l_extendedprice")).alias("price_down"), (F.col("l_quantity").cast("double") - 25.5).alias("v"))

    _add("running_sum_lineitem", lambda s, d: order.running(lines(s, d), "v", *by).select(*columns, "idx", F.round("running", 4).alias("running")), f"SELECT l_orderkey, l_linenumber, idx, round(running, 4) AS running FROM ({sql})")
    top = f"WITH r AS ({sql}) SELECT l_orderkey, l_linenumber, idx, round(running, 4) AS running FROM r WHERE idx <= (SELECT min(idx) FROM r WHERE running = (SELECT max(running) FROM r)) AND (SELECT max(running) FROM r) > 0"
    _add("best_prefix_lineitem", lambda s, d: order.best_prefix(lines(s, d), "v", *by).select(*columns, "idx", F.round("running", 4).alias("running")), top)
    top_so_far = sql.replace("sum(l_quantity::DOUBLE - 25.5)", "max(l_quantity::DOUBLE - 25.5)")
    _add("running_max_lineitem", lambda s, d: order.running(lines(s, d), "v", *by, kind="max").select(*columns, "idx", F.round("running", 4).alias("running")), f"SELECT l_orderkey, l_linenumber, idx, round(running, 4) AS running FROM ({top_so_far})")


def _register_starts() -> None:
    def matrix(spark, sf_dir, graph="supply_und"):
        x = frozen(adapters.GRAPHS[graph](spark, sf_dir)[0].adj_matrix(), "matrix")
        return x, max(2, int(0.1 * x.select("src").distinct().count() / 25))

    def one_step(spark, sf_dir):
        """A vertex component along a given direction: the mean and the median of the columns at its more extreme end."""
        x, p = matrix(spark, sf_dir)
        d = x.select(F.col("src").alias("dst")).distinct().withColumn("d", F.col("dst") * 7919 % 1000 / 1000.0 - 0.5)
        u = x.join(d, "dst").groupBy(F.col("src").alias("node")).agg(F.round(F.sum(F.col("weight") * F.col("d")), 9).alias("u"))
        picked = frozen(starts.ends(u, p), "picked")
        mean, median = starts.column_mean(x, picked, p), starts.column_median(x, picked, p).withColumnRenamed("u", "m")
        return mean.join(median, "node", "left").select("node", F.round("u", 6).alias("mean"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("median"))

    pp = "pp AS (SELECT greatest(2, floor(0.1 * count(DISTINCT src) / 25))::BIGINT AS p FROM x)"
    _add(
        "svca_supply_und",
        one_step,
        views("supply_und")
        + _MATRIX
        + f""", {pp}, u AS (SELECT src AS node, round(sum(x * (dst * 7919 % 1000 / 1000.0::DOUBLE - 0.5)), 9) AS u FROM x GROUP BY src),
o AS (SELECT node, u, row_number() OVER (ORDER BY u DESC, node) AS a, row_number() OVER (ORDER BY u, node DESC) AS z FROM u),
side AS (SELECT abs(median(u) FILTER (a <= p)) > abs(median(u) FILTER (z <= p)) AS high FROM o, pp), picked AS (SELECT node FROM o, pp, side WHERE CASE WHEN high THEN a <= p ELSE z <= p END),
c AS (SELECT u.node, coalesce(x, 0) AS x FROM u CROSS JOIN picked LEFT JOIN x ON src = u.node AND dst = picked.node)
SELECT node, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM c GROUP BY node HAVING max(x) > 0""",
    )

    def projections(spark, sf_dir):
        x, p = matrix(spark, sf_dir)
        return starts.sspa(x, 2, p).select("node", *[F.round(F.col("q")[k], 6).alias(f"w{k}") for k in (0, 1)])

    def step(k: int, rest: str, taken: str) -> str:
        """One projection: from the residuals rest, along the column with the largest, less its part in v0 (if any)."""
        return f"""t{k} AS (SELECT node FROM {rest} ORDER BY rest DESC, node LIMIT 1),
c{k} AS (SELECT dst AS node, x AS c FROM x WHERE src = (SELECT node FROM t{k})), d{k} AS (SELECT n.node, coalesce(c, 0) {taken} AS d FROM rest0 n LEFT JOIN c{k} ON c{k}.node = n.node),
u{k} AS (SELECT src AS node, round(sum(x * d), 9) AS u FROM x JOIN d{k} ON dst = d{k}.node GROUP BY src), p{k} AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY u DESC, node) AS a FROM u{k}), pp WHERE a <= p),
w{k} AS (SELECT n.node, coalesce(w, 0) AS w FROM rest0 n LEFT JOIN (SELECT src AS node, sum(x) / any_value(p) AS w FROM x JOIN p{k} ON dst = p{k}.node, pp GROUP BY src) q ON q.node = n.node)"""

    _add(
        "sspa_supply_und",
        projections,
        views("supply_und")
        + _MATRIX
        + f""", {pp}, rest0 AS (SELECT src AS node, round(sum(x * x), 9) AS rest FROM x GROUP BY src), {step(0, "rest0", "")},
v0 AS (SELECT node, w / (SELECT sqrt(sum(w * w)) FROM w0) AS v FROM w0), rest1 AS (SELECT rest0.node, round(greatest(rest - t * t, 0), 9) AS rest FROM rest0 JOIN (SELECT src, sum(x * v) AS t FROM x JOIN v0 ON dst = node GROUP BY src) ON src = rest0.node),
{step(1, "rest1", "- (SELECT sum(c * v) FROM c1 JOIN v0 USING (node)) * (SELECT v FROM v0 WHERE v0.node = n.node)")}
SELECT w0.node, round(w0.w, 6) AS w0, round(w1.w, 6) AS w1 FROM w0 JOIN w1 USING (node)""",
    )

    for method in ("SVCA", "SSPA"):
        def whole(spark, sf_dir, method=method):
            x, _ = matrix(spark, sf_dir)
            return starts.start(x, 5, method, 1).select("node", "v", F.round("w", 6).alias("w"))

        _add(f"start_{method.lower()}_supply_und", whole, None)


#: One colour step of the tri-factorisation in SQL, from z by the partition; the movers are the suppliers, who share no entry.
_STEP = f""", z AS (SELECT node, block AS v, 1 / sqrt(n) AS w FROM part_ JOIN sz USING (block) WHERE node IN (SELECT src FROM x)),
s AS (SELECT a.v AS k, b.v AS l, sum(a.w * x * b.w) AS val FROM x JOIN z a ON src = a.node JOIN z b ON dst = b.node GROUP BY ALL),
m AS (SELECT v, sum(w * w) AS a FROM z GROUP BY v), wp AS (SELECT l AS k, sum(a * val * val) AS wp2 FROM s JOIN m ON m.v = s.k GROUP BY l),
c AS (SELECT node, k, sum(c) AS c FROM (SELECT src AS node, s.l AS k, -4 * x * z.w * s.val AS c FROM x JOIN z ON dst = z.node JOIN s ON s.k = z.v WHERE src < {adapters.PART_BASE} UNION ALL SELECT node, v, 0.0 FROM z WHERE node < {adapters.PART_BASE}) GROUP BY ALL),
t AS (SELECT c.node, c.k, c.c, z.v, z.w, greatest(coalesce(d.val, 0) ^ 2, 1e-12) AS a, 2 * (coalesce(wp2, 0) - (z.w * coalesce(o.val, 0)) ^ 2) AS b FROM c JOIN z ON z.node = c.node LEFT JOIN s o ON o.k = z.v AND o.l = c.k LEFT JOIN s d ON d.k = c.k AND d.l = c.k LEFT JOIN wp ON wp.k = c.k),
h AS (SELECT *, b / (2 * a) AS p, c / (4 * a) AS q FROM t), g3 AS (SELECT *, q * q / 4 + p * p * p / 27 AS half, sqrt(greatest(-p / 3, 0)) AS r FROM h),
y AS (SELECT *, unnest(CASE WHEN half > 0 THEN [cbrt(-q / 2 + sqrt(half)) + cbrt(-q / 2 - sqrt(half))] ELSE list_transform([0, 1, 2], lambda i: 2 * r * cos(acos(greatest(-1, least(1, CASE WHEN r > 0 THEN -q / (2 * r * r * r) ELSE 0 END))) / 3 - 2 * pi() * i / 3)) END) AS xw FROM g3),
f AS (SELECT *, a * xw ^ 4 + b * xw ^ 2 + c * xw AS f FROM y WHERE xw > 0), best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(f, 9), k) AS rn FROM f WHERE f < 0),
mv AS (SELECT best.node, best.k AS nv, xw AS nw, (t.a * t.w ^ 4 + t.b * t.w ^ 2 + t.c * t.w) - f AS gain FROM best JOIN t ON t.node = best.node AND t.k = t.v WHERE rn = 1)
"""


def _register_descent() -> None:
    def state(spark, sf_dir):
        graph, part = adapters.GRAPHS["supply_und"](spark, sf_dir)
        x = frozen(graph.adj_matrix(), "matrix")
        linked = part.join(x.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
        z = frozen(linked.join(P.block_sizes(part), "block").select("node", F.col("block").alias("v"), (1 / F.sqrt("n")).alias("w")), "z")
        return x, z, descent.coupling(factor.s_matrix(x, z), z)

    def proposed(spark, sf_dir):
        x, z, s = state(spark, sf_dir)
        return descent.proposals(x, z, s, z.where(F.col("node") < adapters.PART_BASE).select("node")), s

    def step(spark, sf_dir):
        return proposed(spark, sf_dir)[0].where("gain > 0.0001").select("node", F.col("nv").cast("int").alias("v"), F.round("nw", 6).alias("w"), F.round("gain", 4).alias("gain"))

    _add("frost_step_supply_und", step, views("supply_und") + _MATRIX + _STEP + "SELECT node, nv AS v, round(nw, 6) AS w, round(gain, 4) AS gain FROM mv WHERE gain > 0.0001")

    def joint(spark, sf_dir):
        found, s = proposed(spark, sf_dir)
        found = frozen(found.where("gain > 0.0001"), "moves")
        return found.agg(F.count("*").alias("movers"), F.round(F.lit(descent.joint_gain(found, s)), 3).alias("gain"))

    after = """, z2 AS (SELECT z.node, coalesce(nv, z.v) AS v, coalesce(nw, z.w) AS w FROM z LEFT JOIN (SELECT * FROM mv WHERE gain > 0.0001) n ON n.node = z.node),
m2 AS (SELECT v, sum(w * w) AS a FROM z2 GROUP BY v)
"""
    fit = lambda z, m: f"((SELECT sum(p.a * r.a * val * val) FROM s JOIN {m} p ON p.v = k JOIN {m} r ON r.v = l) - 2 * (SELECT sum(x * p.w * r.w * val) FROM x JOIN {z} p ON p.node = src JOIN {z} r ON r.node = dst JOIN s ON k = p.v AND l = r.v))"
    _add("frost_joint_gain_supply_und", joint, views("supply_und") + _MATRIX + _STEP + after + f"SELECT (SELECT count(*) FROM mv WHERE gain > 0.0001) AS movers, round({fit('z', 'm')} - {fit('z2', 'm2')}, 3) AS gain")

    def conflicts(spark, sf_dir):
        x = frozen(adapters.GRAPHS["supply_und"](spark, sf_dir)[0].adj_matrix(), "matrix")
        found = frozen(descent.colours(x, 1), "colours")
        ends = x.where("src <> dst").join(found.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(found.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        return found.agg(F.count("*").alias("nodes"), F.countDistinct("node").alias("coloured")).join(F.broadcast(ends.agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))), F.lit(True))  # one row each

    _add("colours_supply_und", conflicts, views("supply_und") + _MATRIX + " SELECT count(DISTINCT src) AS nodes, count(DISTINCT src) AS coloured, 0::BIGINT AS conflicts FROM x")

    def whole(spark, sf_dir):
        x = frozen(adapters.GRAPHS["supply_und"](spark, sf_dir)[0].adj_matrix(), "matrix")
        return descent.frost(x, starts.start(x, 5, "SSPA"), delta=1e-3).z.select("node", "v", F.round("w", 6).alias("w"))

    _add("frost_supply_und", whole, None)


def _register_sampling() -> None:
    def drawn(spark, sf_dir):
        graph, _ = adapters.GRAPHS["supply_und"](spark, sf_dir)
        return sampling.race(graph.edges, ["src"], ["dst"], "weight", 11)

    _add(
        "weighted_draw_supply_und",
        drawn,
        views("supply_und")
        + "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY -ln((('0x' || substr(md5(concat_ws('/', '11', src, dst)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight, dst) AS rn FROM e) WHERE rn = 1",
    )

    def chances(spark, sf_dir):
        graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
        graph = graph.counted()
        s = sampling.state_of(graph, part)
        moves = part.select("node", F.col("block").alias("r")).join(F.broadcast(s.stats.select(F.col("block").alias("t"))), F.col("r") != F.col("t"))  # the regions
        return sampling.chances(s, moves).select("node", "r", "t", F.round("forth", 8).alias("forth"), F.round("back", 8).alias("back"))

    # the back chance from the block edges of every moved partition as a whole
    _add(
        "proposal_chances_nation_und",
        chances,
        views("nation_und")
        + """, mv AS (SELECT row_number() OVER () AS mv, p.node AS m, p.block AS r, c.block AS t FROM part_ p JOIN sz c ON c.block <> p.block),
np AS (SELECT mv, p.node, CASE WHEN p.node = m THEN t ELSE p.block END AS block FROM mv CROSS JOIN part_ p),
be_m AS (SELECT p.mv, p.block AS r, q.block AS s, sum(weight) AS e FROM adj JOIN np p ON src = p.node JOIN np q ON dst = q.node AND q.mv = p.mv GROUP BY ALL),
k_m AS (SELECT mv, r AS u, sum(e) AS k FROM be_m GROUP BY mv, r), cx AS (SELECT src AS node, block AS u, sum(weight) AS w FROM adj JOIN part_ ON dst = node WHERE src <> dst GROUP BY ALL),
dg AS (SELECT node, sum(w) AS d FROM cx GROUP BY node)
SELECT m AS node, mv.r, mv.t, round(sum(w / d * (coalesce(f.e, 0) + 0.1) / (k + 0.1 * b)), 8) AS forth, round(sum(w / d * (coalesce(g2.e, 0) + 0.1) / (k2 + 0.1 * b)), 8) AS back
FROM mv JOIN cx ON cx.node = m JOIN dg ON dg.node = m JOIN (SELECT r AS u, sum(e) AS k FROM be GROUP BY r) k USING (u) LEFT JOIN be f ON f.r = u AND f.s = mv.t
JOIN (SELECT mv, u, k AS k2 FROM k_m) q ON q.mv = mv.mv AND q.u = cx.u LEFT JOIN be_m g2 ON g2.mv = mv.mv AND g2.r = cx.u AND g2.s = mv.r, g GROUP BY m, mv.r, mv.t""",
    )

    def sampled(spark, sf_dir):
        graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
        found = sampling.metropolis_hastings(graph, part, "dckn", 5, 1)
        return found.best.withColumn("value", F.lit(round(found.value, 4)))

    _add("mh_batches_nation_und", sampled, None)


def _register_merging() -> None:
    for name in ("dckn", "skn", "dcpu"):
        def one_round(spark, sf_dir, name=name):
            graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
            return moves.merge_round(graph, part, name).select("block", "into", F.round("delta", 4).alias("delta"))

        inner = _moved_sql(name, "nation_und", *_MOVES["delta_merge"]).replace("round(delta, 4) + 0.0 AS delta FROM mv", "delta FROM mv")
        at = inner.rindex("SELECT fb AS block")
        pairs = f"""pm AS (SELECT least(block, "into") AS a, greatest(block, "into") AS b, max(delta) AS delta FROM ({inner[at:]}) GROUP BY ALL),
en AS (SELECT a AS block, * FROM pm UNION ALL SELECT b, * FROM pm), bt AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY round(delta, 9) DESC, a, b) AS rn FROM en)
SELECT b AS block, a AS "into", round(max(delta), 4) AS delta FROM bt WHERE rn = 1 GROUP BY a, b HAVING count(*) = 2"""
        _add(f"merge_round_{name}_nation_und", one_round, f"{inner[:at].rstrip()},\n{pairs}")

    def whole(spark, sf_dir):
        graph, _ = adapters.GRAPHS["nation_und"](spark, sf_dir)
        return moves.agglomerate(graph, 5, "dckn")

    _add("agglomerate_nation_und", whole, None)

    def to_rest(spark, sf_dir):
        graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
        found = moves.em(graph, part, "dckn", steps=4)
        return found.part.withColumn("value", F.lit(round(found.value, 4))).withColumn("status", F.lit(found.status))

    _add("em_tables_nation_und", to_rest, None)


def _register_hierarchy() -> None:
    """Moves between regions of one parent, of which even and odd regions have one each."""
    moves_sql, keys = _MOVES["delta"]
    for name in ("dckn", "spc"):
        def changes(spark, sf_dir, name=name):
            graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
            above = part.select(F.col("block").alias("node"), (F.col("block") % 2).alias("block")).distinct()
            found = objectives.node_deltas(graph, part, name, hierarchy.sibling_targets(part, above))
            return found.withColumn("delta", F.round("delta", 4) + 0.0)

        _add(f"delta_siblings_{name}_nation_und", changes, _moved_sql(name, "nation_und", moves_sql.replace("c.block <> p.block", "c.block <> p.block AND c.block % 2 = p.block % 2"), keys))

    def nested(spark, sf_dir):
        graph, part = adapters.GRAPHS["nation_und"](spark, sf_dir)
        found = hierarchy.search(graph, 5, "dcpu", part, most=3, steps=2)
        rows = [level.select(F.lit(k).alias("level"), "node", F.col("block").cast("long").alias("block")) for k, level in enumerate(found.levels)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.withColumn("value", F.lit(round(found.value, 4)))

    _add("hierarchy_nation_und", nested, None)

    def by_space(spark, sf_dir, normalised):
        graph, _ = adapters.GRAPHS["nation_und"](spark, sf_dir)
        return spectral.spectral(graph.adj_matrix(), 5, 1, normalised)

    for kind in ("spectral", "spectral_norm"):
        _add(f"{kind}_tables_nation_und", lambda s, d, n=kind.endswith("norm"): by_space(s, d, n), None)


def _register_chances() -> None:
    def chances(spark, sf_dir):
        graph, part = adapters.GRAPHS["supply_und"](spark, sf_dir)
        rows = P.edge_means(graph.counted(), part)
        p = F.least("mean", F.lit(1.0))
        return rows.select("src", "dst", F.round("mean", 6).alias("mean"), *[F.round(special.poisson_pmf(F.lit(k), F.col("mean")), 6).alias(f"poisson_{k}") for k in (0, 1, 2)], F.round(special.bernoulli_pmf(F.lit(1), p), 6).alias("bernoulli_1"))

    pmf = ", ".join(f"round(exp({k} * ln(mean) - mean - lgamma({k} + 1.0)), 6) AS poisson_{k}" for k in (0, 1, 2))
    _add(
        "edge_chances_supply_und",
        chances,
        views("supply_und")
        + f""", dg AS (SELECT src AS node, sum(weight) AS d FROM adj GROUP BY src), sh AS (SELECT node, block, d / ko AS share FROM dg JOIN part_ USING (node) JOIN bs USING (block)),
m AS (SELECT e.src, e.dst, a.share * b.share * be.e AS mean FROM e JOIN sh a ON a.node = e.src JOIN sh b ON b.node = e.dst JOIN be ON be.r = a.block AND be.s = b.block)
SELECT src, dst, round(mean, 6) AS mean, {pmf}, round(least(mean, 1), 6) AS bernoulli_1 FROM m""",
    )


for _register in (_register_objectives, _register_views, _register_selection, _register_metrics, _register_moves, _register_factor, _register_searches, _register_more_searches, _register_order, _register_starts, _register_descent, _register_sampling, _register_merging, _register_hierarchy, _register_chances):
    _register()
