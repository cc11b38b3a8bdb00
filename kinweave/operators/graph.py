"""Graph operators over edge tables ``(src, dst, …)``.

Iterative operators keep their state in DataFrames, cut the lineage in the shared
folder each round and stop when nothing changes. Aggregates (min, sum, count) combine
on the map side, so a hub node costs its tasks one partial row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import name_urls, relation_urls, relation_urls_loose, surnames, title_from_url
from kinweave.operators.aggregates import in_both, quantile_flag
from kinweave.operators.joins import both_in, enrich_both, unknown_endpoints
from kinweave.operators.ranking import first_per_key, top_with_ties
from kinweave.operators.rules import edge_class
from kinweave.operators.sets import endpoints
from kinweave.session import cut, land


# --- building edges and nodes ---------------------------------------------------

def edges(
    df: DataFrame, id_col: str, fields: list[str] = fixed.RELATION_FIELDS, keep: list[str] | None = None,
    mode: str = "strict",
) -> DataFrame:
    """Edge list from relation columns (N01); ``pos`` is the order of mention.

    ``mode``: ``strict`` URLs in parentheses, ``loose`` bare URLs too and no self
    links, ``named`` with the name given in the text.
    """
    def found(c: str) -> Column:
        if mode == "named":
            return name_urls(c)
        urls = relation_urls(c) if mode == "strict" else relation_urls_loose(c, id_col)
        return F.transform(urls, lambda u: F.struct(F.lit(None).cast("string").alias("name"), u.alias("url")))

    present = [f for f in fields if f in df.columns]
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("campo"),
            F.lit(f.removeprefix(fixed.PROFILE_PREFIX)).alias("relation_type"),
            found(f).alias("hits"),
        )
        for i, f in enumerate(present)
    ])
    kept = keep or []
    rows = df.select(F.col(id_col).alias("src"), *kept, F.inline(cells))
    return rows.select(
        "src", *kept, "campo", "relation_type", F.posexplode("hits").alias("pos", "hit")
    ).select("src", F.col("hit.url").alias("dst"), "relation_type", *kept, "campo", "pos",
             F.col("hit.name").alias("related_name"))


def dedupe_edges(e: DataFrame, order: list[str]) -> DataFrame:
    """First relation per ``(src, dst)``, no self-loops."""
    return first_per_key(e.filter(F.col("src") != F.col("dst")), ["src", "dst"], [F.col(c) for c in order])


def nodes(e: DataFrame, persons: DataFrame, key: str = "url") -> DataFrame:
    """Distinct endpoints with name and country; unknown ones get their page title."""
    dim = persons.select(F.col(key).alias("_k"), "nombre", "pais")
    ids = endpoints(e)
    return ids.join(dim, ids["id"] == dim["_k"], "left").select(
        "id", F.coalesce("nombre", title_from_url("id")).alias("nombre"),
        F.coalesce("pais", F.lit("Desconocido")).alias("pais"),
    )


def induced(e: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both endpoints among the ids."""
    return both_in(e, ids, id_col)


def degree(e: DataFrame, all_nodes: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Degree out, in and in total, zero for isolated nodes."""
    ends = e.select(F.col("src").alias(id_col), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        e.select(F.col("dst").alias(id_col), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    if all_nodes is not None:
        ends = ends.unionByName(all_nodes.select(id_col, F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy(id_col).agg(
        F.sum("o").alias("grado_salida"), F.sum("i").alias("grado_entrada"),
        F.sum(F.col("o") + F.col("i")).alias("grado"),
    )


def simplify(e: DataFrame) -> DataFrame:
    """Undirected edges ``src < dst`` without loops and parallels."""
    return collapse(e).filter(F.col("src") != F.col("dst"))


def collapse(e: DataFrame) -> DataFrame:
    """Directed to undirected, any direction, loops kept."""
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def mutual(e: DataFrame) -> DataFrame:
    """Undirected edges for which both directions exist (N08): one aggregate, no self-join."""
    low = F.least("src", "dst")
    return (
        e.filter(F.col("src") != F.col("dst"))
        .groupBy(low.alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.max(F.when(F.col("src") == low, 1).otherwise(0)).alias("f"),
             F.max(F.when(F.col("src") != low, 1).otherwise(0)).alias("r"))
        .filter((F.col("f") == 1) & (F.col("r") == 1)).select("src", "dst")
    )


def neighbours(e: DataFrame) -> DataFrame:
    """Both directions of the simple graph as ``(a, b)``."""
    u = simplify(e)
    return u.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(u.select("dst", "src"))


# --- components, paths, density -----------------------------------------------

def components(e: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """Smallest member id of the component of every node.

    Alternating large-star and small-star rounds: a hub hands its neighbours to the
    smallest one, so long chains and hubs both shrink fast. Stops when a round leaves
    the edge set as it was.
    """
    cur = land(simplify(e).select(F.col("dst").alias("u"), F.col("src").alias("v")))  # u > v
    mark = None
    while True:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()  # both uses below read this one shuffle
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small_low, "u").filter(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        cur = land(star.union(small_low.select("u", "m")).filter(F.col("u") != F.col("v")).distinct())
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    ids = endpoints(e) if all_nodes is None else endpoints(e).union(all_nodes.select("id")).distinct()
    return ids.join(cur.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )


def component_sizes(c: DataFrame) -> DataFrame:
    return c.groupBy("component").agg(F.count("*").alias("n"))


def density(n: str | Column, m: str | Column, directed: bool) -> Column:
    """Share of possible edges; NULL below two nodes."""
    n = F.col(n) if isinstance(n, str) else n
    m = F.col(m) if isinstance(m, str) else m
    possible = n * (n - 1) if directed else n * (n - 1) / 2
    return m / F.nullif(possible.cast("double"), F.lit(0.0))


def avg_degree(n: str | Column, m: str | Column) -> Column:
    """``2m/n`` of the collapsed graph."""
    n = F.col(n) if isinstance(n, str) else n
    m = F.col(m) if isinstance(m, str) else m
    return 2 * m / F.nullif(n.cast("double"), F.lit(0.0))


def triangles(e: DataFrame) -> DataFrame:
    """Every triangle once as ``(x, y, z)``.

    Edges point from the lower to the higher degree, so no node has more than
    ``sqrt(2m)`` outgoing edges and a hub does not open all pairs of its neighbours.
    """
    u = simplify(e)
    deg = u.select(F.col("src").alias("id")).unionAll(u.select("dst")).groupBy("id").count()
    d1 = deg.select(F.col("id").alias("src"), F.col("count").alias("d1"))
    d2 = deg.select(F.col("id").alias("dst"), F.col("count").alias("d2"))
    rank1, rank2 = F.struct("d1", "src"), F.struct("d2", "dst")
    o = u.join(d1, "src").join(d2, "dst").select(
        F.when(rank1 < rank2, F.col("src")).otherwise(F.col("dst")).alias("x"),
        F.when(rank1 < rank2, F.col("dst")).otherwise(F.col("src")).alias("y"),
    )
    o = cut(o)
    wedge = o.join(o.select("x", F.col("y").alias("z")), "x").filter(F.col("y") < F.col("z"))
    return wedge.join(u.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"], "left_semi")


def transitivity(e: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Triangles, connected triples and ``3 * triangles / triples``.

    ``by`` is a table ``(id, grupo)``: one row per group of a graph without edges
    between groups.
    """
    u = simplify(e)
    deg = u.select(F.col("src").alias("id")).unionAll(u.select("dst")).groupBy("id").count()
    per_node = deg.select(
        "id", F.lit(0).cast("long").alias("t"), (F.col("count") * (F.col("count") - 1) / 2).cast("long").alias("w")
    ).unionByName(triangles(e).groupBy(F.col("x").alias("id")).agg(F.count("*").alias("t")).withColumn("w", F.lit(0).cast("long")))
    if by is not None:
        per_node = per_node.join(by, "id")
    out = per_node.groupBy(*(["grupo"] if by is not None else [])).agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("triangulos"), F.coalesce(F.sum("w"), F.lit(0)).alias("triples")
    )
    return out.withColumn(
        "transitividad", 3 * F.col("triangulos") / F.nullif(F.col("triples").cast("double"), F.lit(0.0))
    )


def _levels(adj: DataFrame, sources: DataFrame, directed: bool) -> list[DataFrame]:
    """Breadth-first levels ``(s, v, d, sigma)`` of all sources at once.

    The state has a row for each pair of nodes that reach each other, so these measures are for
    contracted graphs (families, houses, countries); persons are ranked by degree and neighbour groups.
    """
    levels = [cut(sources.select(
        F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")
    ))]
    while True:
        last = levels[-1]
        # In an undirected graph a neighbour is at most one level back.
        seen = levels if directed else levels[-2:]
        visited = reduce(DataFrame.union, [x.select("s", "v") for x in seen])
        step = (
            last.join(adj, last["v"] == adj["a"])
            .groupBy("s", F.col("b").alias("v"))
            .agg((F.first("d") + 1).alias("d"), F.sum(F.col("sigma") * F.col("mult")).alias("sigma"))
            .join(visited, ["s", "v"], "left_anti")
        )
        step = cut(step)
        if step.isEmpty():
            return levels
        levels.append(step)


def _adjacency(e: DataFrame, directed: bool, multi: bool) -> DataFrame:
    loopless = e.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if not directed:
        loopless = loopless.union(loopless.select("b", "a"))
    counted = loopless.groupBy("a", "b").agg(F.count("*").cast("double").alias("mult"))
    return cut(counted if multi else counted.withColumn("mult", F.lit(1.0)))


def shortest_paths(e: DataFrame, directed: bool = False) -> DataFrame:
    """Distances and path counts ``(s, v, d, sigma)`` of reachable pairs of a contracted graph."""
    adj = _adjacency(e, directed, multi=False)
    return reduce(DataFrame.union, _levels(adj, _nodes_of(adj), directed))


def _nodes_of(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("a").alias("id")).union(adj.select("b")).distinct()


def avg_path(e: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Mean distance over connected pairs of a contracted graph (N13), per group of ``by(id, grupo)`` if given."""
    keys = ["grupo"] if by is not None else []
    far = shortest_paths(e).filter(F.col("d") > 0)
    if by is not None:
        far = far.join(by.withColumnRenamed("id", "s"), "s")
    return far.groupBy(*keys).agg(F.count("*").alias("pares"), F.avg("d").alias("distancia_media"))


def giant_nodes(c: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Nodes of the largest component (smallest label on ties), per group if given."""
    sizes = component_sizes(c)
    if by is None:
        best = sizes.orderBy(F.desc("n"), "component").limit(1)
    else:
        label = by.withColumnRenamed("id", "component")
        best = first_per_key(sizes.join(label, "component"), ["grupo"], [F.desc("n"), F.col("component")])
    return c.join(best.select("component"), "component", "left_semi").select("id", "component")


def betweenness(
    e: DataFrame, all_nodes: DataFrame | None = None, directed: bool = False, normalized: bool = False, multi: bool = False,
) -> DataFrame:
    """Shortest-path betweenness of a contracted graph (N14): forward levels, then dependencies back to the source.

    Each unordered pair counts once; ``directed`` counts ordered pairs. ``multi`` lets
    parallel edges count as separate paths. Dependencies add up level by level, so
    no pair of pairs is ever joined.
    """
    adj = _adjacency(e, directed, multi)
    back = adj.select(F.col("a").alias("pred"), F.col("b").alias("w"), "mult")
    levels = _levels(adj, _nodes_of(adj), directed)
    deeper = levels[-1].withColumn("delta", F.lit(0.0))
    scored = []
    for k in range(len(levels) - 1, 0, -1):
        scored.append(deeper.select("v", "delta"))
        if k == 1:
            break
        share = deeper.join(back, deeper["v"] == back["w"]).select(
            "s", F.col("pred").alias("v"), (F.col("mult") * (1 + F.col("delta")) / F.col("sigma")).alias("x")
        ).groupBy("s", "v").agg(F.sum("x").alias("x"))
        deeper = cut(levels[k - 1].join(share, ["s", "v"], "left").select(
            "s", "v", "d", "sigma", (F.col("sigma") * F.coalesce("x", F.lit(0.0))).alias("delta")
        ))
    ids = endpoints(e) if all_nodes is None else endpoints(e).union(all_nodes.select("id")).distinct()
    if scored:
        total = reduce(DataFrame.union, scored).groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("bt"))
        ids = ids.join(total, "id", "left")
    else:
        ids = ids.withColumn("bt", F.lit(0.0))
    scale = 1.0 if directed else 0.5
    if normalized:
        n = ids.count()
        pairs = (n - 1) * (n - 2) / (1 if directed else 2)
        scale = scale / pairs if pairs else 0.0
    return ids.select("id", (F.coalesce("bt", F.lit(0.0)) * scale).alias("betweenness"))


# --- communities -----------------------------------------------------------------

def moves_in(round_no: int) -> Column:
    """About half of the nodes, another half in each round."""
    return F.instr(F.lit("13579bdf"), F.right(F.md5(F.concat_ws(":", "id", F.lit(round_no)).cast("binary")), F.lit(1))) > 0


def communities(
    e: DataFrame, mode: str = "any", all_nodes: DataFrame | None = None, rounds: int | None = None,
) -> DataFrame:
    """Communities by label propagation, run until no node wants another label.

    ``rounds`` asks for the labels after so many rounds instead, where a result is defined by them: on large
    graphs that is before they have settled.

    A node wants the most frequent label among its neighbours and itself, the smallest on ties.
    In each round a hashed half of the nodes may move, so neighbours do
    not swap labels for ever, and the result is the same on every run. ``mutual`` keeps
    two-way edges only. State is written, as the size estimates of checkpointed frames are
    multiplied in every round: they have twice the digits after each, and fill the driver.
    """
    simple = mutual(e) if mode == "mutual" else simplify(e)
    ids = endpoints(e) if all_nodes is None else all_nodes.select("id").distinct()
    adj = land(neighbours(simple))
    labels = land(ids.withColumn("community", F.col("id")).withColumn("wanted", F.lit(-1).cast("long")))
    round_no = 0
    while rounds is None or round_no < rounds:
        own = labels.select("id", "community")
        votes = adj.join(own, adj["b"] == own["id"]).select(F.col("a").alias("id"), "community").unionAll(own)
        counted = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        best = counted.join(own.withColumnRenamed("community", "own"), "id").groupBy("id").agg(
            F.min(F.struct(-F.col("n"), F.col("community").alias("c")))["c"].alias("wanted"),
            F.first("own").alias("community"))
        now = land(best)
        if now.filter(F.col("wanted") != F.col("community")).isEmpty():
            return now.select("id", "community")
        labels = now.withColumn("community", F.when(moves_in(round_no), F.col("wanted")).otherwise(F.col("community")))
        round_no += 1
    return labels.select("id", "community")


def communities_any(e: DataFrame, rounds: int | None = None) -> DataFrame:
    """Communities over all edges with the community size on every node."""
    c = communities(e, "any", rounds=rounds)
    sizes = c.groupBy("community").agg(F.count("*").alias("size"))
    return c.join(sizes, "community").select("id", "community", "size")


def modularity(e: DataFrame, c: DataFrame) -> DataFrame:
    """Modularity of a partition of the simple graph, one row."""
    u = simplify(e)
    lab = c.select("id", "community")
    inside = u.join(lab.withColumnsRenamed({"id": "src", "community": "cs"}), "src").join(
        lab.withColumnsRenamed({"id": "dst", "community": "cd"}), "dst"
    ).select(F.explode(F.array(
        F.struct(F.col("cs").alias("c"), F.when(F.col("cs") == F.col("cd"), 1).otherwise(0).alias("l")),
        F.struct(F.col("cd").alias("c"), F.lit(0).alias("l")),
    )).alias("x")).select("x.*")
    per = inside.groupBy("c").agg(F.sum("l").alias("l"), F.count("*").alias("d"))
    m2 = F.sum("d").cast("double")
    # sum over c of l/m - (d/2m)^2 with 2m = sum of degrees.
    return per.agg(F.sum("l").alias("l"), m2.alias("m2"), F.sum(F.col("d") * F.col("d")).alias("dd")).select(
        (2 * F.col("l") / F.nullif("m2", F.lit(0.0)) - F.col("dd") / F.nullif(F.col("m2") * F.col("m2"), F.lit(0.0))).alias("modularidad")
    )


def community_labels(c: DataFrame, at_least: int = 10) -> DataFrame:
    """Community sizes and labels; small ones share a label."""
    return c.groupBy("community").agg(F.count("*").alias("n")).withColumn(
        "community_label",
        F.when(F.col("n") >= at_least, F.concat(F.lit("Clúster "), F.col("community"))).otherwise("Pequeño"),
    )


def mixed_communities(c: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """Communities with members of both countries."""
    return in_both(c, "community", side, a, b)


# --- group graphs -------------------------------------------------------------

def contract(e: DataFrame, src_group: str, dst_group: str) -> DataFrame:
    """Weighted graph of groups."""
    return e.groupBy(F.col(src_group).alias("src"), F.col(dst_group).alias("dst")).agg(F.count("*").alias("weight"))


def marriage_network(e: DataFrame, p: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Marriages between families and the families' centrality.

    A to B and B to A stay two parallel edges, as both count in degree and paths.
    """
    spouse = e.filter(
        F.col("relation_type").isin(fixed.SPOUSE_RELATIONS) & (F.col("clase_familia") == "Inter-familia")
    )
    links = cut(contract(spouse, "src_familia", "dst_familia"))
    score = degree(links).join(betweenness(links, multi=True), "id")
    return links, quantile_flag(score.select("id", "grado", "betweenness"), "grado", p, "familia_central")


def neighbour_groups(e: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct groups among the neighbours of each node (N20); ``membership(id, grupo)``."""
    near = neighbours(e)
    groups = near.join(membership.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
        F.count_distinct("grupo").alias("familias_conectadas")
    )
    return endpoints(e).join(groups, "id", "left").fillna(0, subset=["familias_conectadas"])


def inter_group(e: DataFrame) -> DataFrame:
    """Edges between two known, different families."""
    return e.filter(F.col("src_familia") != F.col("dst_familia"))


def group_connectivity(n: DataFrame, top: int = 10) -> DataFrame:
    """Degree sum and linked members per family, first ``top`` per country with ties."""
    out = n.filter(F.col("grado") > 0).groupBy("pais", "familia").agg(
        F.sum("grado").alias("total_conexiones"), F.count("*").alias("n_miembros")
    )
    return top_with_ties(out, ["pais"], "total_conexiones", top)


def pair_summary(e: DataFrame) -> DataFrame:
    """Nodes, nodes per side and crossing edges of every country pair that edges connect.

    ``e`` has ``src, dst, src_pais, dst_pais`` (NULL when unknown). A pair holds the edges whose ends are in one of its countries or
    unknown. Each node is reduced to the countries it touches, so the pairs are
    joined to small count tables and never to edges.
    """
    unk = F.lit("Desconocido")
    dst_pais = F.coalesce("dst_pais", unk)
    touch = e.select(F.col("src").alias("id"), F.col("src_pais").alias("own"), dst_pais.alias("t")).union(
        e.select("dst", dst_pais, F.col("src_pais"))
    )
    per_node = touch.groupBy("id", "own").agg(
        F.max(F.when((F.col("t") == F.col("own")) | (F.col("t") == "Desconocido"), 1).otherwise(0)).alias("always"),
        F.array_sort(F.collect_set("t")).alias("ts"),
    )
    # Nodes with the same countries are one row from here on.
    shape = cut(per_node.groupBy("own", "always", "ts").agg(F.count("*").alias("n")))
    known = shape.filter(F.col("own") != "Desconocido")
    base = known.filter(F.col("always") == 1).groupBy("own").agg(F.sum("n").alias("n"))
    extra = known.filter(F.col("always") == 0).select("own", F.explode("ts").alias("t"), "n").groupBy("own", "t").agg(F.sum("n").alias("n"))
    lost = shape.filter(F.col("own") == "Desconocido")
    u1 = lost.select(F.explode("ts").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    u2 = lost.select("ts", F.explode("ts").alias("t"), "n").select("t", F.explode("ts").alias("t2"), "n").groupBy("t", "t2").agg(F.sum("n").alias("n"))
    cross = e.filter(F.col("src_pais") != F.col("dst_pais")).groupBy(
        F.least("src_pais", "dst_pais").alias("a"), F.greatest("src_pais", "dst_pais").alias("b")
    ).agg(F.count("*").alias("cruces"))
    pairs = cross.select("a", "b")

    def add(df: DataFrame, side: DataFrame, names: dict[str, str], out: str) -> DataFrame:
        s = side.withColumnsRenamed({**names, "n": out})
        return df.join(s, list(names.values()), "left")

    p = add(pairs, base, {"own": "a"}, "_ba")
    p = add(p, base, {"own": "b"}, "_bb")
    p = add(p, extra, {"own": "a", "t": "b"}, "_ea")
    p = add(p, extra, {"own": "b", "t": "a"}, "_eb")
    p = add(p, u1, {"t": "a"}, "_ua")
    p = add(p, u1, {"t": "b"}, "_ub")
    p = add(p, u2, {"t": "a", "t2": "b"}, "_uab")
    p = p.join(cross, ["a", "b"], "left").fillna(0)
    n_a, n_b = F.col("_ba") + F.col("_ea"), F.col("_bb") + F.col("_eb")
    return p.select(
        "a", "b", (n_a + n_b + F.col("_ua") + F.col("_ub") - F.col("_uab")).alias("nodos"),
        n_a.alias("n_a"), n_b.alias("n_b"), "cruces",
    ).filter(F.col("n_a") + F.col("n_b") > 0)


# --- traversal and completion --------------------------------------------------

def k_hop(e: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """Nodes within ``k`` steps along the edges, with their depth."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    out = e.select("src", "dst").distinct()
    for d in range(1, k + 1):
        step = frontier.join(out, frontier["id"] == out["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(frontier)
    return seen


def flatten_hierarchy(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Every descendant of every root with its depth (N25); ``tree(parent, child)``."""
    seen = cut(roots.select(F.col("id").alias("root"), F.col("id").alias("member"), F.lit(0).alias("depth")))
    frontier = seen
    d = 0
    while True:
        d += 1
        step = frontier.join(tree, frontier["member"] == tree["parent"]).select("root", F.col("child").alias("member")).distinct()
        frontier = cut(step.join(seen, ["root", "member"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            return seen.filter(F.col("depth") > 0)
        seen = seen.union(frontier)


def reciprocal(e: DataFrame, inverse: dict[str, str] = fixed.INVERSE_RELATION) -> DataFrame:
    """Edges plus the missing way back of each, with the inverse relation."""
    have = e.select("src", "dst", "relation_type").distinct()
    inv = F.col("relation_type")
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for rel, back in inverse.items():
        case = case.when(inv == rel, back)
    turned = have.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), case.otherwise(inv).alias("relation_type")
    ).distinct()
    missing = turned.join(have.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return have.withColumn("anadida", F.lit(False)).unionByName(missing.withColumn("anadida", F.lit(True)))


def unknown_profile(e: DataFrame, known: DataFrame, key: str = "person_id") -> DataFrame:
    """Origin of edges to unknown persons, by country and relation."""
    return unknown_endpoints(e, known, key).groupBy("src_pais", "relation_type").agg(F.count("*").alias("n"))


def unknown_examples(e: DataFrame, known: DataFrame, order: list[str], n: int = 20, key: str = "person_id") -> DataFrame:
    """First ``n`` distinct edges to unknown persons."""
    return unknown_endpoints(e, known, key).distinct().orderBy(*order).limit(n)


def crossing_named(e: DataFrame) -> DataFrame:
    """Distinct edges between two known countries with readable names."""
    return (
        e.filter(F.col("src_pais") != F.col("dst_pais"))
        .select("src_nombre", "dst_nombre", "relation_type", "src_pais", "dst_pais").distinct()
    )


def surname_network(persons: DataFrame, e: DataFrame, key: str = "person_id") -> tuple[DataFrame, DataFrame]:
    """Surname pairs carried together and surname to surname flows."""
    s = persons.select(F.col(key).alias("id"), surnames("nombre").alias("s")).select("id", "s.*")
    pairs = s.dropna().filter(F.col("surname_1") != F.col("surname_2")).groupBy(
        F.least("surname_1", "surname_2").alias("pair_a"), F.greatest("surname_1", "surname_2").alias("pair_b")
    ).agg(F.count("*").alias("weight"))
    one = s.select("id", "surname_1")
    flows = enrich_both(e.select("src", "dst"), one, ["surname_1"], "id").filter(F.col("src_surname_1").isNotNull())
    flows = flows.groupBy(
        F.col("src_surname_1").alias("from_surname"),
        F.coalesce("dst_surname_1", F.lit("External")).alias("to_surname"),
    ).agg(F.count("*").alias("weight"))
    return pairs, flows.filter(F.col("from_surname") != F.col("to_surname"))


def kin_table(e: DataFrame, persons: DataFrame, attrs: list[str], key: str = "person_id") -> DataFrame:
    """Edges with attributes and classes of both ends: the base of most reports."""
    return edge_class(enrich_both(e, persons, attrs, key))


def membership(persons: DataFrame, key: str, group: str) -> DataFrame:
    return persons.select(F.col(key).alias("id"), F.col(group).alias("grupo"))

