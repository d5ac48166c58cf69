"""Pairs of similar articles, clusters built from them, and approximate nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepress.functions.vectors import as_matrix
from pulsepress.operators.ingest import new_rows
from pulsepress.operators.joins import attach, small_or_shuffled
from pulsepress.operators.search import nearest_rows
from pulsepress.schemas import CLUSTER_EPS
from pulsepress.sources.scratch import scratch_folder

# Most centres tried, vectors they are tried on, and rows of one side compared in one task.
MAX_CENTRES = 1024
TRIAL_ROWS = 1024
TILE_ROWS = 8192
# A cell with more rows is split again, by at most so many centres of its own tried on so many of its rows.
LEAF_ROWS = 4 * TILE_ROWS
BRANCHES, BRANCH_TRIAL = 64, 256
# Approximate search: buckets from the query's that are tried in turn, and candidates for each row of the limit.
REACHES = (0, 1, 3, 7)
CANDIDATES = 4

_SLACK = 1e-6


def distinct_vectors(articles: DataFrame, same_categories: bool = True) -> DataFrame:
    """One row per different vector (and category list): its first url and how many articles share it.

    Copies are counted before the shuffle, so a vector shared by many articles stays one row. Where
    the articles have a ``fresh`` column, a vector is fresh when any article with it is.
    """
    usable = articles.filter(F.col("embedding").isNotNull())
    if same_categories:
        usable = usable.filter(F.col("categories").isNotNull())
    group = F.to_json("categories") if same_categories else F.lit("")
    fresh = F.max("fresh") if "fresh" in articles.columns else F.lit(True)
    return (
        usable.groupBy(group.alias("group"), "embedding")
        .agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("copies"), fresh.alias("fresh"))
        .select("group", "url", "embedding", "copies", "fresh")
    )


def copies(articles: DataFrame, same_categories: bool = True) -> DataFrame:
    """(url, first_url) of every article that repeats the vector of an earlier url."""
    shared = distinct_vectors(articles, same_categories).filter("copies > 1")
    group = F.to_json("categories") if same_categories else F.lit("")
    keyed = articles.filter(F.col("embedding").isNotNull()).select("url", "embedding", group.alias("group"))
    firsts = shared.select("group", "embedding", F.col("url").alias("first_url"))
    joined = attach(keyed, firsts, ["group", "embedding"], how="inner")
    return joined.filter(F.col("url") != F.col("first_url")).select("url", "first_url")


def vector_pairs(
    articles: DataFrame,
    eps: float = CLUSTER_EPS,
    same_categories: bool = True,
    cells: int | None = None,
    tile_rows: int = TILE_ROWS,
    fresh: DataFrame | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(url, related_url, distance), both directions, of different vectors at most ``eps`` apart (L2).

    Exact, without comparing all pairs: every vector belongs to the cell of its nearest centre and
    also visits each other cell whose border is within ``eps``. A pair is found once in the cell of
    its second member. The number of cells is the one that moves the fewest rows on a small sample,
    unless it is given. Cells of more than ``leaf_rows`` rows are split in the same way by centres of
    their own, level by level, as long as that saves work, so the work grows with the rows where
    vectors can be told apart. Cells larger than a tile are then cut, and each pair of tiles is one task.
    Articles with equal vectors count once here, see ``copies``. With ``fresh``, a table of urls, only
    pairs with at least one of these articles are sought, and no others are compared.
    """
    if fresh is not None:
        marks = fresh.select("url", F.lit(True).alias("fresh")).distinct()
        articles = articles.select("url", "categories", "embedding").join(small_or_shuffled(marks), "url", "left")
        articles = articles.withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    usable = articles.filter(F.col("embedding").isNotNull())
    largest = _largest_group(usable, same_categories)
    if not largest:
        return articles.sparkSession.createDataFrame([], "url string, related_url string, distance double")
    centres = _centres(usable, largest, eps, cells, tile_rows)
    vectors = distinct_vectors(articles, same_categories).drop("copies")
    placed = vectors.withColumn("cells", _cells(centres, eps)(F.col("embedding")))
    placed = placed.select(
        "group", "url", "embedding", "fresh", F.posexplode("cells").alias("place", "cell")
    )
    placed = placed.select(
        "group", "url", "embedding", F.col("cell").cast("string").alias("cell"), ((F.col("place") == 0) & F.col("fresh")).alias("home")
    )
    if largest > leaf_rows:
        placed = _split(placed, eps, centres.shape[1], tile_rows, leaf_rows)
    if fresh is None and largest <= tile_rows:
        tiled = placed.withColumns({"homes": F.lit(1), "all": F.lit(1)})
    else:
        tiled = _with_tiles(placed, tile_rows, fresh is not None)
    own_home = F.pmod(F.xxhash64("url"), F.col("homes")).cast("int")
    own = F.pmod(F.xxhash64("url", F.lit("all")), F.col("all")).cast("int")
    as_home = F.transform(
        F.sequence(F.lit(0), F.col("all") - 1),
        lambda j: F.struct(own_home.alias("i"), j.alias("j"), F.lit(True).alias("as_home"), (j == own).alias("as_any")),
    )
    as_any = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: ~F.col("home") | (i != own_home)),
        lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("as_home"), F.lit(True).alias("as_any")),
    )
    spots = F.when(F.col("home"), F.concat(as_home, as_any)).otherwise(as_any)
    spread = tiled.select("group", "cell", "url", "embedding", F.explode(spots).alias("s")).select(
        "group", "cell", "s.i", "s.j", "s.as_home", "s.as_any", "url", "embedding"
    )
    pairs = spread.groupBy("group", "cell", "i", "j").applyInArrow(
        _compare(eps, centres.shape[1]), "url string, related_url string, distance double"
    )
    # Here a pair was found from its fresh side, or from both.
    return pairs if fresh is None else both_ways(pairs).distinct()


def _moved(homes: float, rows: float, visits: float, count: int, tile_rows: int) -> float:
    """Rows moved to compare a cell that ``count`` centres split, each row visiting ``visits`` of the parts.

    A home row goes to all tiles of rows in its part, any row to all tiles of home rows in the parts it visits.
    """
    tiles = rows * visits / count / tile_rows
    home_tiles = homes / count / tile_rows
    return homes * max(1.0, tiles) + rows * visits * max(1.0, home_tiles)


def _split(placed: DataFrame, eps: float, length: int, tile_rows: int, leaf_rows: int) -> DataFrame:
    """The placed rows with large cells split, level by level, until none is large or splitting saves nothing.

    Each level counts the cells, chooses centres for the large ones from a hashed sample of bounded size,
    one task a cell, and places their rows anew, one task for about a tile of rows. A row at home in a
    cell is at home in one of its parts; the others that it visits follow the same rule as above. The
    names of cells are the paths to them. A cell that no centres split cheaper keeps its rows and is
    not tried again.
    """
    folder = scratch_folder(placed.sparkSession)
    keys, done, level = ["group", "cell"], [], 0
    current = placed
    while True:
        path = f"{folder}/level{level}"
        current.write.parquet(path)
        current = placed.sparkSession.read.schema(placed.schema).parquet(path)
        sizes = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
        large = sizes.filter((F.col("n") > leaf_rows) & (F.col("h") > 0))
        # About twice the wanted sample by hash, so that the window below sees a bounded number of rows.
        wanted = BRANCHES + BRANCH_TRIAL
        point = F.pmod(F.xxhash64("url", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = attach(current, large, keys, how="inner").filter(point * F.col("n") < 2 * wanted)
        ranked = Window.partitionBy(*keys).orderBy(F.xxhash64("url", F.lit(level)), "url")
        sample = drawn.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= wanted)
        chosen = sample.select(*keys, "n", "h", "place", "embedding").groupBy(*keys).applyInArrow(
            _branches(eps, length, tile_rows), "group string, cell string, n bigint, centres array<array<double>>"
        )
        chosen.write.parquet(f"{path}-centres")
        chosen = placed.sparkSession.read.schema(chosen.schema).parquet(f"{path}-centres")
        if not chosen.limit(1).count():
            break
        pieces = chosen.select(*keys, F.ceil(F.col("n") / tile_rows).cast("int").alias("pieces"))
        marked = attach(current, pieces, keys)
        done.append(marked.filter(F.col("pieces").isNull()).drop("pieces"))
        inner = marked.filter(F.col("pieces").isNotNull())
        inner = inner.withColumn("piece", F.pmod(F.xxhash64("url", F.lit("piece")), F.col("pieces")).cast("int"))
        centres = chosen.join(pieces, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "centres")
        by = [*keys, "piece"]
        current = (
            inner.groupBy(*by).cogroup(centres.groupBy(*by)).applyInArrow(_parts(eps, length), "group string, url string, "
            "embedding array<float>, cell string, home boolean")
        ).select(*placed.columns)
        level += 1
    for part in done:
        current = current.unionByName(part)
    return current


def _branches(eps: float, length: int, tile_rows: int):
    """Centres for a large cell, as many as make its comparison cheapest; no row when it stays whole."""
    schema = pa.schema(
        [("group", pa.string()), ("cell", pa.string()), ("n", pa.int64()), ("centres", pa.list_(pa.list_(pa.float64())))]
    )

    def choose(key, rows):
        rows = rows.sort_by("place")
        n, homes = rows["n"][0].as_py(), rows["h"][0].as_py()
        _, points = as_matrix(rows["embedding"].combine_chunks(), length)
        points = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
        trial = points[-BRANCH_TRIAL:]
        # To place the rows anew moves each once more.
        best, least = 1, _moved(homes, n, 1.0, 1, tile_rows) - n
        for count in (4, 16, BRANCHES):
            if count > len(points):
                break
            moved = _moved(homes, n, _visited(trial, points[:count], eps)[1].sum(1).mean(), count, tile_rows)
            if moved < least:
                best, least = count, moved
        if best == 1:
            return schema.empty_table()
        return pa.table([[key[0]], [key[1]], [n], [points[:best].tolist()]], schema=schema)

    return choose


def _parts(eps: float, length: int):
    """The rows of a piece of a cell in the parts that they visit."""

    def place(key, rows, centres):
        rows = rows.select(["group", "url", "embedding", "cell", "home"])
        points = np.array(centres["centres"][0].as_py(), dtype="float64")
        positions, matrix = as_matrix(rows["embedding"].combine_chunks(), length)
        own, visits = _visited(matrix, points, eps)
        row, part = np.nonzero(visits)
        out = rows.take(pa.array(positions[row]))
        home = pc.and_(out["home"], pa.array(part == own[row]))
        names = pc.binary_join_element_wise(out["cell"], pa.array(part.astype(str)), ".")
        out = out.set_column(3, "cell", names)
        return out.set_column(4, "home", home)

    return place


def _with_tiles(placed: DataFrame, tile_rows: int, some_homes: bool) -> DataFrame:
    """Rows with the number of tiles of their cell, for home rows and for all rows.

    Cells without a home row are dropped where only some rows are at home.
    """

    def tiles(rows: str) -> Column:
        return F.greatest(F.ceil(F.col(rows) / tile_rows), F.lit(1)).cast("int")

    counts = placed.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
    counts = counts.filter(F.col("h") > 0) if some_homes else counts.filter(F.col("n") > tile_rows)
    sizes = counts.select("group", "cell", tiles("h").alias("homes"), tiles("n").alias("all"))
    joined = attach(placed, sizes, ["group", "cell"], how="inner" if some_homes else "left")
    return joined.fillna(1, ["homes", "all"])


def _largest_group(usable: DataFrame, same_categories: bool) -> int:
    """Rows of the most frequent category list, or of the whole table; 0 when it is empty."""
    group = [F.to_json("categories").alias("group")] if same_categories else []
    sizes = usable.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first()["n"] or 0


def _centres(usable: DataFrame, largest: int, eps: float, cells: int | None, tile_rows: int) -> np.ndarray:
    """Some of the vectors, chosen by the hash of their url: as many as make the join cheapest.

    Each row goes once to every tile of the cells it visits, and every home row meets all tiles of
    its cell. Few cells mean many tiles, many cells mean many visits; the sample tells how many.
    """
    some = usable.orderBy(F.xxhash64("url"), "url").limit(MAX_CENTRES + TRIAL_ROWS).select("embedding").collect()
    points = np.array([r["embedding"] for r in some], dtype="float64")
    points = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
    if cells:
        return points[:cells]
    best, least = 1, None
    for count in (1, 4, 16, 64, 256, MAX_CENTRES):
        if count > min(len(points), max(1, largest // 64)):
            break
        visits = _visited(points[-TRIAL_ROWS:], points[:count], eps)[1].sum(1).mean()
        moved = _moved(largest, largest, visits, count, tile_rows)
        if least is None or moved < least:
            best, least = count, moved
    return points[:best]


def _visited(matrix: np.ndarray, centres: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, cells that can hold a vector within ``eps``) of every vector.

    A segment from a vector to one in another cell crosses the plane midway between both centres, so
    only cells whose plane is within ``eps`` can hold a partner.
    """
    between = np.array([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])
    squared = _squared(matrix, centres)
    home = squared.argmin(axis=1)
    nearest = squared[np.arange(len(home)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        to_plane = (squared - nearest[:, None]) / (2.0 * between[home])
    return home, ~(to_plane > eps + _SLACK)


def _cells(centres: np.ndarray, eps: float):
    """Cells of a vector, its own first."""

    @F.arrow_udf("array<int>")
    def place(embeddings: pa.Array) -> pa.Array:
        positions, matrix = as_matrix(embeddings, centres.shape[1])
        result: list = [None] * len(embeddings)
        if len(positions):
            home, visits = _visited(matrix, centres, eps)
            for row, position in enumerate(positions):
                others = np.flatnonzero(visits[row])
                result[position] = [int(home[row])] + [int(c) for c in others if c != home[row]]
        return pa.array(result, pa.list_(pa.int32()))

    return place


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


def _compare(eps: float, length: int):
    schema = pa.schema([("url", pa.string()), ("related_url", pa.string()), ("distance", pa.float64())])

    def compare(tile: pa.Table) -> pa.Table:
        homes = tile.filter(tile["as_home"])
        others = tile.filter(tile["as_any"])
        if not homes.num_rows or not others.num_rows:
            return schema.empty_table()
        home_rows, a = as_matrix(homes["embedding"].combine_chunks(), length)
        other_rows, b = as_matrix(others["embedding"].combine_chunks(), length)
        found = []
        step = max(1, 4_000_000 // max(1, len(b)))
        for start in range(0, len(a), step):
            part = a[start : start + step]
            left, right = np.nonzero(_squared(part, b) <= (eps + _SLACK) ** 2 + _SLACK)
            exact = np.sqrt(((part[left] - b[right]) ** 2).sum(1))
            close = exact <= eps
            found.append((left[close] + start, right[close], exact[close]))
        left, right, gap = (np.concatenate(x) for x in zip(*found))
        urls = others["url"].combine_chunks().take(pa.array(other_rows[right]))
        related = homes["url"].combine_chunks().take(pa.array(home_rows[left]))
        pairs = pa.table([urls.cast(pa.string()), related.cast(pa.string()), pa.array(gap)], schema=schema)
        return pairs.filter(pc.not_equal(pairs["url"], pairs["related_url"]))

    return compare


def similar_pairs(
    articles: DataFrame, eps: float = CLUSTER_EPS, same_categories: bool = True, fresh: DataFrame | None = None
) -> DataFrame:
    """(url, related_url, distance) links between similar articles, both directions.

    Different vectors within ``eps`` are linked pair by pair. Articles with one and the same vector
    are linked to the first of them only, at distance 0: a group of n copies gives 2(n - 1) rows
    instead of n(n - 1). ``related_to`` unfolds every pair for chosen articles.
    """
    star = copies(articles, same_categories).select(
        "url", F.col("first_url").alias("related_url"), F.lit(0.0).alias("distance")
    )
    return vector_pairs(articles, eps, same_categories, fresh=fresh).union(both_ways(star))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Every pair and its reverse, read once."""
    rest = [c for c in pairs.columns if c not in ("url", "related_url")]
    one = F.struct("url", "related_url")
    other = F.struct(F.col("related_url").alias("url"), F.col("url").alias("related_url"))
    ways = pairs.select(F.explode(F.array(one, other)).alias("p"), *rest)
    return ways.select("p.url", "p.related_url", *rest)


def closure(pairs: DataFrame) -> DataFrame:
    """Pairs and their reverse, each once."""
    return both_ways(pairs).distinct()


def related_to(urls: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Every (url, related_url) for the given urls, from ``vector_pairs`` and ``copies``."""
    wanted = urls.select("url").distinct().join(links, "url", "left")
    wanted = wanted.select("url", F.coalesce("first_url", "url").alias("first"))
    near = wanted.join(pairs.select(F.col("url").alias("first"), "related_url"), "first")
    firsts = near.select("url", "related_url").union(wanted.select("url", F.col("first").alias("related_url")))
    members = firsts.join(
        links.select(F.col("first_url").alias("related_url"), F.col("url").alias("copy")), "related_url"
    ).select("url", F.col("copy").alias("related_url"))
    return firsts.union(members).filter(F.col("url") != F.col("related_url")).distinct()


def new_related(related: DataFrame, articles: DataFrame, eps: float = CLUSTER_EPS, all_pairs: bool = False) -> DataFrame:
    """Similar pairs that are not stored yet, sought for the unmapped articles or for all of them.

    Articles with equal vectors are paired like any others, n(n - 1) rows for n of them, so that counts
    and lists over the stored pairs are whole.
    """
    fresh = None if all_pairs else unmapped(articles, related).select("url")
    found = vector_pairs(articles, eps, fresh=fresh)
    wanted = articles.filter(F.col("embedding").isNotNull() & F.col("categories").isNotNull()) if all_pairs else fresh
    pairs = related_to(wanted, found, copies(articles))
    return new_rows(related, pairs if all_pairs else closure(pairs), ["url", "related_url"])


def unmapped(articles: DataFrame, related: DataFrame) -> DataFrame:
    """Articles with an embedding that no related pair starts from."""
    return articles.filter(F.col("embedding").isNotNull()).join(related.select("url").distinct(), "url", "left_anti")


def assign_clusters(pairs: DataFrame) -> DataFrame:
    """(url, cluster_id, related): each article joins its nearest neighbour, ties by url.

    ``related`` is the number of neighbours of the chosen centre. ``pairs`` holds both directions.
    """
    centre = F.min(F.struct(F.round("distance", 6).alias("distance"), "related_url"))["related_url"]
    members = pairs.groupBy("url").agg(centre.alias("cluster_id"))
    sizes = pairs.groupBy(F.col("url").alias("cluster_id")).agg(F.count(F.lit(1)).alias("related"))
    return attach(members, sizes, "cluster_id", how="inner").select("url", "cluster_id", "related")


def similar_clusters(articles: DataFrame, eps: float = CLUSTER_EPS, same_categories: bool = True) -> DataFrame:
    """``assign_clusters`` over all similar pairs, without unfolding articles that share a vector.

    Articles with equal vectors have the same neighbours, so these are counted once for each vector
    from the number of articles that share it. Their own nearest is the first of the others.
    """
    near, links = vector_pairs(articles, eps, same_categories), copies(articles, same_categories)
    groups = links.groupBy(F.col("first_url").alias("first")).agg(
        (F.count(F.lit(1)) + 1).alias("copies"), F.min("url").alias("second")
    )
    sizes = groups.select(F.col("first").alias("related_url"), "copies")
    others = attach(near, sizes, "related_url").groupBy(F.col("url").alias("first")).agg(
        F.sum(F.coalesce("copies", F.lit(1))).alias("others"),
        F.min(F.struct(F.round("distance", 6).alias("distance"), F.col("related_url").alias("url"))).alias("other"),
    )
    firsts = others.join(groups, "first", "full").select(
        "first", "other", "second", (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("related")
    )
    members = firsts.select(F.col("first").alias("url"), "first").union(links.select("url", F.col("first_url").alias("first")))
    placed = attach(members, firsts.drop("related"), "first", how="inner")
    copy = F.when(F.col("url") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    own = F.when(F.col("second").isNotNull(), F.struct(F.lit(0.0).alias("distance"), copy.alias("url")))
    placed = placed.withColumn("centre", F.least(own, F.col("other"))["url"])
    # The centre is a copy of the article's own vector or the first article of another one.
    centre_first = F.when(F.col("centre") == F.col("second"), F.col("first")).otherwise(F.col("centre"))
    placed = placed.select("url", F.col("centre").alias("cluster_id"), centre_first.alias("first"))
    return attach(placed, firsts.select("first", "related"), "first", how="inner").select("url", "cluster_id", "related")


def in_cluster(clusters: DataFrame, url: str) -> DataFrame:
    """The other articles in the cluster of one article."""
    own = clusters.filter((F.col("url") == url) & F.col("cluster_id").isNotNull()).select("cluster_id")
    # One row: the url is the key of the table.
    return clusters.filter(F.col("url") != url).join(F.broadcast(own), "cluster_id", "left_semi")


def cluster_sizes(clusters: DataFrame, urls: Sequence[str] | DataFrame) -> DataFrame:
    """(cluster_id, url, cluster_size) for some urls; articles without a cluster count as one group."""
    # The marked id is never NULL, so articles without a cluster join like any other group.
    marked = clusters.select("url", "cluster_id", F.struct(F.col("cluster_id").alias("id")).alias("group"))
    sizes = marked.groupBy("group").agg(F.count(F.lit(1)).alias("cluster_size"))
    if isinstance(urls, DataFrame):
        wanted = marked.join(urls.select("url").distinct(), "url", "left_semi")
    else:
        wanted = marked.filter(F.col("url").isin(list(urls)))
    joined = attach(wanted.distinct(), sizes, "group", how="inner")
    return joined.select("cluster_id", "url", "cluster_size")


def approximate_nearest(
    df: DataFrame,
    query: Sequence[float],
    limit: int,
    bucket: float = 1.0,
    tables: int = 4,
    seed: int = 1,
    metric: str = "l2",
    key: str = "url",
) -> DataFrame:
    """Nearest rows among those in random-projection buckets at or near the query's.

    The exact distance is computed for these candidates only. Buckets further away are taken in until
    there are ``CANDIDATES`` rows for each row of the limit, at last all rows; without a limit all rows
    are ranked. Wider buckets and more hash tables find more of the true neighbours.
    """
    vectors = df.filter(F.col("embedding").isNotNull()).withColumn("__v", array_to_vector("embedding"))
    model = BucketedRandomProjectionLSH(
        inputCol="__v", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=seed
    ).fit(vectors)
    spark = df.sparkSession
    asked = spark.createDataFrame([([float(x) for x in query],)], "embedding array<double>")
    own = model.transform(asked.withColumn("__v", array_to_vector("embedding"))).first()["__h"]
    hashed = model.transform(vectors)
    gaps = [F.abs(vector_to_array(F.col("__h")[i])[0] - F.lit(float(own[i][0]))) for i in range(tables)]
    hits = hashed
    for reach in REACHES if limit else ():
        some = hashed.filter(F.array_min(F.array(*gaps)) <= reach)
        if some.limit(CANDIDATES * limit).count() == CANDIDATES * limit:
            hits = some
            break
    return nearest_rows(hits.drop("__v", "__h"), query, limit, metric=metric, key=key)
