"""Connected components, triangles, clustering coefficients, degree power law."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillgraph.operators.graph import NATURAL, REVERSE, UNDIRECTED, Adjacency, Graph, degrees, restrict_edges
from quillgraph.session import cut, forget


def _spread_min(adjacency: Adjacency, state: DataFrame) -> DataFrame:
    """One round: each node takes the least label among its own and those sent to it."""
    sent = adjacency.attach(state.select("id", "label")).select(
        F.col("dst").alias("id"), "label", F.lit(None).cast(state.schema["label"].dataType).alias("old"))
    held = state.select("id", "label", F.col("label").alias("old"))
    merged = held.unionByName(sent).groupBy("id").agg(F.min("label").alias("label"), F.min("old").alias("old"))
    return merged.select("id", "label", (F.col("label") < F.col("old")).alias("moved"))


def _least_labels(adjacency: Adjacency, state: DataFrame) -> DataFrame:
    """id, label: the least label among those of all nodes that reach a node along the edges. Labels must be node ids, and `state` a stored table.

    After each round labels jump to the label of their label, which reaches the node as well, so long chains shorten
    geometrically.
    """
    while True:
        spread = cut(_spread_min(adjacency, state))
        forget(state)
        if spread.filter("moved").isEmpty():
            return spread.select("id", "label")
        roots = spread.select(F.col("label").alias("id")).distinct()
        jump = roots.join(spread.select("id", F.col("label").alias("next")), "id").filter("next < id").select(
            F.col("id").alias("label"), "next")
        state = cut(spread.join(jump, "label", "left").select("id", F.coalesce("next", "label").alias("label")))
        forget(spread)


def _own_labels(nodes: DataFrame) -> DataFrame:
    return cut(nodes.select("id", F.col("id").alias("label")))


def weak_components(graph: Graph) -> DataFrame:
    """id, component (least id of the part)."""
    adjacency = Adjacency(graph.oriented(UNDIRECTED).select("src", "dst"), "src")
    return _least_labels(adjacency, _own_labels(graph.nodes)).withColumnRenamed("label", "component")


#: Trimming goes on by itself while it takes away more than this share of the nodes.
TRIM_SHARE = 0.1


def _neighbourhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ins, outs, before (the one in-neighbour, if there is one), after. Edges are distinct and without loops."""
    none = F.lit(None).cast(nodes.schema["id"].dataType)
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), none.alias("before"), F.col("dst").alias("after")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("before"), none.alias("after")))).alias("e")).select("e.*")
    alone = nodes.select("id", none.alias("before"), none.alias("after"))
    return alone.unionByName(ends).groupBy("id").agg(
        F.count("before").alias("ins"), F.count("after").alias("outs"), F.min("before").alias("before"), F.min("after").alias("after"))


def _chains(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of nodes with one way in and one way out, by pointer jumping: as many passes as the logarithm of the longest.

    Returns the members (id, tail: last link of its chain), the chains (tail, enter: node before the first link, leave: node
    after the last), and the rings that nothing enters (id, root: least id of the ring).
    """
    ids = links.select("id")
    state = cut(links.select("id", "before", F.col("id").alias("tail"), F.col("after").alias("to"), F.col("id").alias("least"), F.lit(True).alias("open")))
    for _ in range(n.bit_length() + 1):  # pointers of a pass are twice as long as before; what is open after the last one goes round
        ahead = state.select(F.col("id").alias("to"), F.col("tail").alias("tail2"), F.col("to").alias("to2"), F.col("least").alias("least2"),
                             F.col("open").alias("open2"))
        step = state.filter("open").join(ahead, "to", "left").select(
            "id", "before", F.coalesce("tail2", "tail").alias("tail"), F.coalesce("to2", "to").alias("to"), F.least("least", "least2").alias("least"),
            F.coalesce("open2", F.lit(False)).alias("open"))
        longer = cut(state.filter("not open").unionByName(step))
        forget(state)
        state = longer
        if state.filter("open").isEmpty():
            break
    ended = state.filter("not open")
    first = ended.join(ids.withColumnRenamed("id", "before"), "before", "left_anti")
    return (ended.select("id", "tail"), first.select("tail", F.col("before").alias("enter"), F.col("to").alias("leave")),
            state.filter("open").select("id", F.col("least").alias("root")))


def strong_components(graph: Graph) -> DataFrame:
    """id, component (least id of the part).

    A round first takes away nodes without a way in or out, and whole chains: an edge from the node before a chain to the one behind it
    stands for the chain, whose links belong to the component of both if that is one and the same, and else to none. Then every node
    learns the least node that reaches it, and inside the nodes with the same answer the least node that it reaches. Where both
    agree the component is found; edges between nodes with different answers go. So each round finds a component in every part of
    the graph at once. Integer ids are scrambled, so that parts split at random places and rounds follow the logarithm
    of the number of components in a row; the hash of one 64-bit number maps them one to one (other ids keep their order). Deep lattices without chains are trimmed by the labels.
    """
    whole = isinstance(graph.nodes.schema["id"].dataType, IntegralType)
    forth = (lambda c: F.xxhash64(F.col(c).cast("long")).alias(c)) if whole else F.col
    nodes = cut(graph.nodes.select(forth("id")).distinct())
    edges = cut(restrict_edges(graph.edges.filter("src <> dst").select(forth("src"), forth("dst")).distinct(), nodes))
    done: list[DataFrame] = []
    chains: list[tuple[DataFrame, DataFrame]] = []
    while not nodes.isEmpty():
        shape = cut(_neighbourhoods(nodes, edges))
        trim, link = "ins = 0 or outs = 0", "ins = 1 and outs = 1"
        total, trimmed, linked = shape.agg(F.count("*"), F.count_if(F.expr(trim)), F.count_if(F.expr(link))).first()
        if trimmed:
            done.append(shape.filter(trim).select("id", F.col("id").alias("root")))
        if trimmed or linked:
            kept = cut(shape.filter(f"not ({trim}) and not ({link})").select("id"))
            bridges = edges
            if linked:
                members, spans, rings = _chains(shape.filter(link).select("id", "before", "after"), linked)
                done.append(rings)
                chains.append((members, spans))
                bridges = edges.unionByName(spans.filter("enter <> leave").select(F.col("enter").alias("src"), F.col("leave").alias("dst")))
            shorter = cut(restrict_edges(bridges, kept).distinct() if linked else restrict_edges(bridges, kept))
            forget(nodes)
            forget(edges)
            nodes, edges = kept, shorter
            if trimmed + linked > TRIM_SHARE * total:
                continue
        seen = _least_labels(Adjacency(edges, "src"), _own_labels(nodes))
        ends = [seen.select(F.col("id").alias(end), F.col("label").alias(label)) for end, label in (("src", "c1"), ("dst", "c2"))]
        inner = cut(edges.join(ends[0], "src").join(ends[1], "dst").filter("c1 = c2").select("src", "dst"))
        reached = _least_labels(Adjacency(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src"), _own_labels(nodes))
        both = cut(seen.join(reached.withColumnRenamed("label", "least"), "id"))
        done.append(both.filter("label = least").select("id", F.col("label").alias("root")))
        rest = both.filter("label <> least")
        ends = [rest.select(F.col("id").alias(end), F.col("least").alias(label)) for end, label in (("src", "c1"), ("dst", "c2"))]
        forget(nodes)
        forget(edges)
        nodes = cut(rest.select("id"))
        edges = cut(inner.join(ends[0], "src").join(ends[1], "dst").filter("c1 = c2").select("src", "dst"))
        forget(inner)
    if not done:
        return graph.nodes.select("id", F.col("id").alias("component"))
    roots = functools.reduce(DataFrame.unionByName, done)
    for members, spans in reversed(chains):  # what a chain joins may be a link of a later one
        of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        closed = spans.join(of("enter"), "enter").join(of("leave"), "leave").filter("enter_root = leave_root")
        found = members.join(closed.select("tail", F.col("enter_root").alias("root")), "tail", "left")
        roots = roots.unionByName(cut(found.select("id", F.coalesce("root", "id").alias("root"))))
    names = graph.nodes.select("id", forth("id").alias("key")).distinct()
    named = cut(roots.withColumnRenamed("id", "key").join(names, "key").select("id", "root"))
    return named.join(named.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def component_summary(components: DataFrame, articles: DataFrame) -> DataFrame:
    """component, categories (distinct), members."""
    return components.join(articles.select("id", "category"), "id").groupBy("component").agg(
        F.countDistinct("category").alias("categories"), F.count("*").alias("members"))


def triangle_counts(graph: Graph) -> DataFrame:
    """id, triangles (edges taken as undirected, parallel edges once).

    Edges point from the lower to the higher (degree, id), so a node has at most sqrt(2m) outgoing
    neighbours; that bounds the neighbour arrays whose intersections close the triangles.
    """
    pairs = cut(graph.undirected_pairs(sum_weights=False).select("a", "b"))
    deg = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    ranked = pairs.join(deg.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(
        deg.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    up = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    arcs = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    out = cut(arcs.groupBy("u").agg(F.collect_list("v").alias("ahead")))
    wide = out.select("u", F.explode("ahead").alias("v"), "ahead")
    shut = wide.join(out.select(F.col("u").alias("v"), F.col("ahead").alias("beyond")), "v").select(
        "u", "v", F.array_intersect("ahead", "beyond").alias("third"))
    shut = shut.filter(F.size("third") > 0)
    corners = shut.select(F.explode(F.concat(
        F.array(F.struct(F.col("u").alias("id"), F.size("third").cast("long").alias("n")),
                F.struct(F.col("v").alias("id"), F.size("third").cast("long").alias("n"))),
        F.transform("third", lambda w: F.struct(w.alias("id"), F.lit(1).cast("long").alias("n"))),
    )).alias("c")).select("c.*")
    none = graph.nodes.select("id", F.lit(0).cast("long").alias("n"))
    return none.unionByName(corners).groupBy("id").agg(F.sum("n").alias("triangles"))


def local_clustering(graph: Graph) -> DataFrame:
    """id, triangles, degree, coefficient = 2T / (k (k - 1)), 0 below two neighbours."""
    simple = Graph(graph.nodes.select("id"), graph.undirected_pairs(False).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")))
    k = F.col("degree")
    return triangle_counts(simple).join(degrees(simple, UNDIRECTED), "id").select(
        "id", "triangles", "degree",
        F.when(k >= 2, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(0.0).alias("coefficient"))


# The coefficients of Abramowitz and Stegun 7.1.26 for the error function (error below 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(z: Column) -> Column:
    """1 - erf(z) for z >= 0."""
    t = 1.0 / (1.0 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-z * z)


def power_law_fit(distribution: DataFrame) -> DataFrame:
    """alpha, xmin, ks, log_likelihood, lognormal_log_likelihood, ratio, p, mean, median from degree, nodes.

    Discrete maximum likelihood for every observed degree as lower bound, all at once: suffix sums over
    the histogram (one row per distinct degree, at most sqrt(2m) rows) give each candidate's alpha; the
    bound with the least Kolmogorov-Smirnov distance wins. `p` tells whether the sign of the ratio of both likelihoods
    is chance (Vuong's test). Mean and median are those of all positive degrees.
    """
    h = cut(distribution.filter("degree >= 1").select(F.col("degree").cast("double").alias("x"), F.col("nodes").cast("double").alias("c")))
    down = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = h.select(
        "x", "c", F.row_number().over(Window.orderBy("x")).alias("r"), F.sum("c").over(down).alias("n"),
        F.sum(F.col("c") * F.ln("x")).over(down).alias("sl"))
    tails = cut(tails.withColumn("alpha", 1.0 + F.col("n") / (F.col("sl") - F.col("n") * F.ln(F.col("x") - 0.5))))
    last = tails.agg(F.max("r")).scalar()
    fitted = tails.select(F.col("x").alias("x0"), "n", "alpha", F.explode(F.sequence(F.col("r"), last)).alias("r"))
    grid = fitted.join(tails.select("r", "x", "c"), "r")
    upto = Window.partitionBy("x0").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = grid.withColumn("empirical", F.sum("c").over(upto) / F.col("n"))
    model = 1.0 - F.pow((F.col("x") + 0.5) / (F.col("x0") - 0.5), 1.0 - F.col("alpha"))
    best = seen.groupBy("x0", "n", "alpha").agg(F.max(F.abs(F.col("empirical") - model)).alias("ks")).orderBy("ks", "x0").limit(1)
    picked = cut(best)
    lx = F.ln("x")
    tail = h.filter(F.col("x") >= picked.select("x0").scalar())
    used = tail.agg(F.sum(F.col("c") * lx).alias("sl"), F.sum(F.col("c") * lx * lx).alias("sl2"))
    moments = used.select("sl", "sl2", *[picked.select(a).scalar().alias(b) for a, b in (
        ("x0", "xmin"), ("alpha", "alpha"), ("ks", "ks"), ("n", "n"))]).withColumn("mu", F.col("sl") / F.col("n")).withColumn(
        "var", F.col("sl2") / F.col("n") - F.col("mu") * F.col("mu"))
    two_pi = 2 * F.lit(3.141592653589793)
    power = F.col("n") * F.ln((F.col("alpha") - 1) / (F.col("xmin") - 0.5)) - F.col("alpha") * (
        F.col("sl") - F.col("n") * F.ln(F.col("xmin") - 0.5))
    normal = -F.col("sl") - F.col("n") / 2 * (F.ln(two_pi * F.col("var")) + 1)
    fit = cut(moments.withColumn("log_likelihood", power).withColumn("lognormal_log_likelihood", normal).withColumn("ratio", power - normal))
    one = F.ln((F.col("alpha") - 1) / (F.col("xmin") - 0.5)) - F.col("alpha") * (lx - F.ln(F.col("xmin") - 0.5))
    other = -lx - F.ln(two_pi * F.col("var")) / 2 - (lx - F.col("mu")) * (lx - F.col("mu")) / (2 * F.col("var"))
    spread = tail.join(F.broadcast(fit)).agg(F.sum(F.col("c") * F.pow(one - other - F.col("ratio") / F.col("n"), F.lit(2.0))).alias("squares")).scalar()
    whole = h.select("x", "c", F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    n = h.agg(F.sum("c")).scalar()
    middle = lambda k: whole.filter(F.col("upto") > k).agg(F.min("x")).scalar()
    return fit.select(
        "alpha", "xmin", "ks", "log_likelihood", "lognormal_log_likelihood", "ratio",
        erfc(F.abs("ratio") / F.sqrt(2.0 * spread)).alias("p"), h.agg(F.sum(F.col("x") * F.col("c")) / F.sum("c")).scalar().alias("mean"),
        ((middle(F.floor((n - 1) / 2)) + middle(F.ceil((n - 1) / 2))) / 2).alias("median"))
