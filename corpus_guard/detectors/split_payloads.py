"""Payloads split over files: a search over the orders of a group's fragments, whose joins go down the decode ladder.

Groups are the fragments of a repo by alphabet and, since a piece of a payload may by chance fit a narrower
alphabet, the unions of an alphabet with all narrower ones, so that groups share members. A group takes part from
``LEAST`` fragments in two files on. Groups of at most ``PERMUTED`` fragments are joined in every order, larger ones by path,
by length and by appearance, forwards and, for the first two, backwards.

``find_split_payloads`` takes all fragments of all groups. Up to ``MOST`` fragments and ``JOINED_CHARS`` characters a group is
an array in a row. Of a larger one no row holds the whole: its fragments are ranked by a distributed sort, their places in each
join are sums over the sorted parts, and the join is decoded by chunks of ``CHUNK`` characters; only a join that decodes from end to end is put
together. ``scan_split_payloads`` and ``reassemble`` are bounded: the first ``MOST`` fragments of a group by path and place, and a
finding of how many were left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_guard.detectors.python_jobs import decode_rescan, decodes_in_part
from corpus_guard.functions.scalars import alphabet_of
from corpus_guard.plans.staging import counted, stage

LEAST, MOST = 3, 256
PERMUTED, PERMUTED_CHARS = 6, 64 * 1024
#: Characters of a join; in the bounded search fragments that would pass it, and those behind them, are left out of that order.
JOINED_CHARS = 1 << 20
#: Characters of a chunk of a longer join, a multiple of what each decoder takes at a time, and of the next chunk that it sees.
CHUNK, AHEAD = 40 * 1024, 40
#: The unions, and the alphabets in them, the widest last.
UNIONS = {"base64+": ("hex", "base32", "base64"), "base85+": ("hex", "base32", "base64", "base85")}


def fragment_groups(frags: DataFrame) -> DataFrame:
    """(repo, path, frag, ord) once for each group that the fragment is in, with ``widest``: whether its alphabet is the group's own."""
    kind = frags.withColumn("alphabet", alphabet_of("frag")).where("alphabet is not null")
    places = [F.struct(F.col("alphabet").alias("grp"), F.lit(True).alias("widest"))]
    places += [F.when(F.col("alphabet").isin(*held), F.struct(F.lit(name).alias("grp"), (F.col("alphabet") == held[-1]).alias("widest"))) for name, held in UNIONS.items()]
    return kind.withColumn("g", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull()))).select("repo", "g.grp", "g.widest", "path", "frag", "ord")


def group_sizes(groups: DataFrame, least: int = LEAST) -> DataFrame:
    """(repo, grp, n) of groups that may hold a split payload; unions count where they hold both their own alphabet and a narrower one."""
    sizes = groups.groupBy("repo", "grp").agg(
        F.count("*").alias("n"), F.sum(F.length("frag")).alias("chars"), (F.min("path") != F.max("path")).alias("spread"), F.bool_or("widest").alias("own"), F.bool_and("widest").alias("pure")
    )
    return sizes.where((F.col("n") >= least) & F.col("spread") & (~F.endswith("grp", F.lit("+")) | (F.col("own") & ~F.col("pure")))).select("repo", "grp", "n", "chars")


def _joined(order: Column) -> Column:
    """The fragments of an ordered array up to the length cap as one string."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("chars"), F.lit(True).alias("open"))

    def add(acc, x):
        fits = acc["open"] & (acc["chars"] + F.length(x["frag"]) <= JOINED_CHARS)
        return F.struct(F.when(fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.when(fits, acc["chars"] + F.length(x["frag"])).otherwise(acc["chars"]).alias("chars"), fits.alias("open"))

    return F.array_join(F.slice(F.transform(order, lambda x: x["frag"]), 1, F.aggregate(order, start, add)["k"]), "")


def _permutations(spark: SparkSession) -> DataFrame:
    """(size, orders): all orders of up to ``PERMUTED`` fragments."""
    orders = [(n, [list(p) for p in permutations(range(n))]) for n in range(LEAST, PERMUTED + 1)]
    return F.broadcast(spark.createDataFrame(orders, "size int, orders array<array<int>>"))


def _members(groups: DataFrame) -> DataFrame:
    """Groups as arrays ``m`` by path and place."""
    return groups.groupBy("repo", "grp").agg(F.array_sort(F.collect_list(F.struct("path", "ord", "frag"))).alias("m"))


def _array_joins(groups: DataFrame) -> DataFrame:
    """(repo, path, blob): the distinct joins of groups that fit into a row."""
    members = _members(groups)
    by = lambda *keys: F.array_sort(F.transform("m", lambda x: F.struct(*[F.length(x["frag"]).alias("n") if k == "n" else x[k].alias(k) for k in (*keys, "frag")])))
    path, length, seen = by("path", "ord"), by("n", "path", "ord"), by("ord", "path")
    ways = F.array(*[_joined(x) for x in (path, F.reverse(path), length, F.reverse(length), seen)])
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.length(x["frag"]))
    tried = members.withColumn("size", F.when(chars <= PERMUTED_CHARS, F.size("m"))).join(_permutations(groups.sparkSession), "size", "left")
    all_ways = F.transform("orders", lambda p: F.array_join(F.transform(p, lambda i: F.get("m", i)["frag"]), ""))
    blobs = F.array_distinct(F.concat(ways, F.coalesce(all_ways, F.array().cast("array<string>"))))
    return tried.select("repo", F.concat(F.lit("reassembled:"), "grp").alias("path"), F.explode(blobs).alias("blob"))


def reassemble(frags: DataFrame, most: int = MOST) -> DataFrame:
    """(repo, path, blob): the distinct joins of each group of fragments(repo, path, frag, ord)."""
    groups = fragment_groups(frags)
    sizes = group_sizes(groups)
    ranked = groups.withColumn("rn", F.row_number().over(Window.partitionBy("repo", "grp").orderBy("path", "ord", "frag"))).where(F.col("rn") <= most)
    return _array_joins(ranked.join(sizes.select("repo", "grp"), ["repo", "grp"], "left_semi"))


def _every_order(groups: DataFrame) -> DataFrame:
    """The same for a few long fragments: every order is a row of its own."""
    tried = _members(groups).withColumn("size", F.size("m")).join(_permutations(groups.sparkSession), "size").select("repo", "grp", "m", F.explode("orders").alias("p"))
    return tried.select("repo", F.concat(F.lit("reassembled:"), "grp").alias("path"), F.array_join(F.transform("p", lambda i: F.get("m", i)["frag"]), "").alias("blob"))


def _places(groups: DataFrame) -> DataFrame:
    """(repo, grp, way, at, frag, total): where each fragment begins in each join of its group, by sums over a distributed sort."""
    zero, n = F.lit(0), F.length("frag")
    ways = F.array(*[F.struct(F.lit(w).alias("way"), a.alias("k1"), b.alias("k2")) for w, a, b in (("path", zero, zero), ("length", n, zero), ("seen", zero, F.col("ord")))])
    keys = ["repo", "grp", "way", "k1", "k2", "path", "ord", "frag"]
    rows = groups.withColumn("w", F.explode(ways)).select("repo", "grp", "w.*", "path", "ord", "frag").repartitionByRange(*keys)
    rows = stage(rows.withColumn("part", F.spark_partition_id()), "ordered-fragments")
    sums = rows.groupBy("repo", "grp", "way", "part").agg(F.sum(n).alias("chars"))
    join = Window.partitionBy("repo", "grp", "way")
    sums = sums.withColumn("before", F.coalesce(F.sum("chars").over(join.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), zero)).withColumn("total", F.sum("chars").over(join)).drop("chars")
    here = Window.partitionBy("repo", "grp", "way", "part").orderBy(*keys[3:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("here", F.coalesce(F.sum(n).over(here), zero)).join(sums, ["repo", "grp", "way", "part"])
    at = F.col("before") + F.col("here")
    both = F.array(F.struct("way", at.alias("at")), F.when(F.col("way") != "seen", F.struct(F.concat("way", F.lit("-back")).alias("way"), (F.col("total") - at - n).alias("at"))))
    return placed.select("repo", "grp", "frag", "total", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("b")).select("repo", "grp", "b.*", "frag", "total")


def _chunk_joins(groups: DataFrame, chunk: int) -> DataFrame:
    """The same for groups that fit into no row: the joins that some decoder takes from end to end."""
    at, n, c = F.col("at"), F.length("frag"), F.col("chunk")
    spread = _places(groups).withColumn("chunk", F.explode(F.sequence(F.greatest(F.floor((at - AHEAD) / chunk), F.lit(0).cast("long")), F.floor((at + n - 1) / chunk))))
    start, end = F.greatest(c * chunk - at, F.lit(0).cast("long")), F.least(n.cast("long"), (c + 1) * chunk + AHEAD - at)
    piece = F.struct((at + start).alias("at"), F.substring(F.col("frag"), (start + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    chunks = spread.groupBy("repo", "grp", "way", "total", "chunk").agg(F.array_sort(F.collect_list(piece)).alias("ps"))
    chunks = stage(chunks.select("repo", "grp", "way", "total", "chunk", F.array_join(F.transform("ps", lambda x: x["piece"]), "").alias("text")), "joined-chunks")

    # by rows, as in the ladder
    @F.udf("array<struct<decoder:string,n:long,printable:long>>", useArrow=False)
    def parts(text, first):
        return decodes_in_part(text[:chunk], text[chunk:], first)

    read = chunks.select("repo", "grp", "way", "total", F.explode(parts("text", c == 0)).alias("d")).select("repo", "grp", "way", "total", "d.*")
    whole = read.groupBy("repo", "grp", "way", "total", "decoder").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"), F.sum("printable").alias("printable"))
    whole = whole.where((F.col("chunks") == F.floor((F.col("total") - 1) / chunk) + 1) & (F.col("n") > 0) & (F.col("printable") / F.col("n") >= 0.85))
    kept = chunks.join(whole.select("repo", "grp", "way").distinct(), ["repo", "grp", "way"], "left_semi").groupBy("repo", "grp", "way")
    texts = F.array_sort(F.collect_list(F.struct("chunk", F.substring("text", 1, chunk).alias("text"))))
    return kept.agg(F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("blob")).select("repo", F.concat(F.lit("reassembled:"), "grp").alias("path"), "blob")


def find_split_payloads(frags: DataFrame, most: int = MOST, joined: int = JOINED_CHARS, chunk: int = CHUNK) -> DataFrame:
    """J4 into C20 over all fragments of all groups: (repo, path, category, severity, detail): calls decoded from joined fragments.

    ``most``, ``joined`` and ``chunk`` (a multiple of 40) say what a row may hold, not what is searched.
    """
    groups = fragment_groups(stage(frags, "fragments"))
    many = F.col("n") > PERMUTED
    way = F.when(many & ((F.col("n") > most) | (F.col("chars") > joined)), "chunks").when(~many & (F.col("chars") > PERMUTED_CHARS), "orders").otherwise("array")
    sizes = counted(group_sizes(groups).select("repo", "grp", way.alias("how")), "fragment-groups")
    of = lambda how: groups.join(sizes.where(F.col("how") == how), ["repo", "grp"], "left_semi")
    blobs = _array_joins(of("array")).unionByName(_every_order(of("orders"))).unionByName(_chunk_joins(of("chunks"), chunk))
    return _calls(blobs)


def _calls(blobs: DataFrame) -> DataFrame:
    found = decode_rescan(blobs)
    return found.select("repo", "path", F.lit("split-payload").alias("category"), F.lit("critical").alias("severity"), F.concat_ws(" ", "trail", "call").alias("detail")).distinct()


def scan_split_payloads(frags: DataFrame, most: int = MOST) -> DataFrame:
    """J4 into C20, bounded: (repo, path, category, severity, detail): calls decoded from joined fragments, and groups of which fragments were left out."""
    calls = _calls(reassemble(frags, most))
    over = group_sizes(fragment_groups(frags)).where(F.col("n") > most)
    left = over.select("repo", F.concat(F.lit("reassembled:"), "grp").alias("path"), F.lit("split-group-limit").alias("category"), F.lit("low").alias("severity"), F.concat((F.col("n") - most).cast("string"), F.lit(" fragments left out")).alias("detail"))
    return calls.unionByName(left)


_ALPHABET = "CASE WHEN regexp_matches(frag, '^[0-9a-fA-F]+$') THEN 'hex' WHEN regexp_matches(frag, '^[A-Z2-7]+=*$') THEN 'base32' WHEN regexp_matches(frag, '^[A-Za-z0-9+/_-]+=*$') THEN 'base64' WHEN regexp_matches(frag, '^[!-u]+$') THEN 'base85' END"

#: The same for DuckDB over frag(repo, path, frag, ord); joins stay under the cap, since collected fragments are short.
REASSEMBLE_SQL = f"""kind AS (SELECT *, {_ALPHABET} AS alphabet FROM frag),
grouped AS (SELECT repo, alphabet AS grp, true AS widest, path, frag, ord FROM kind WHERE alphabet IS NOT NULL
  UNION ALL SELECT repo, 'base64+', alphabet = 'base64', path, frag, ord FROM kind WHERE alphabet IN ('hex', 'base32', 'base64')
  UNION ALL SELECT repo, 'base85+', alphabet = 'base85', path, frag, ord FROM kind WHERE alphabet IN ('hex', 'base32', 'base64', 'base85')),
sized AS (SELECT repo, grp FROM grouped GROUP BY repo, grp HAVING count(*) >= {LEAST} AND min(path) <> max(path) AND (NOT ends_with(grp, '+') OR (bool_or(widest) AND NOT bool_and(widest)))),
ranked AS (SELECT g.* FROM grouped g JOIN sized USING (repo, grp) QUALIFY row_number() OVER (PARTITION BY repo, grp ORDER BY path, ord, frag) <= {MOST}),
m AS (SELECT repo, grp, count(*) AS size, sum(length(frag)) AS chars, list(frag ORDER BY path, ord, frag) AS p, list(frag ORDER BY length(frag), path, ord, frag) AS l, list(frag ORDER BY ord, path, frag) AS s FROM ranked GROUP BY repo, grp),
perm AS (SELECT n, []::BIGINT[] AS used FROM range({LEAST}, {PERMUTED + 1}) t(n) UNION ALL SELECT n, list_append(used, i) FROM perm, range(1, {PERMUTED + 1}) r(i) WHERE len(used) < n AND i <= n AND NOT list_contains(used, i)),
ways AS (SELECT repo, grp, unnest([p, list_reverse(p), l, list_reverse(l), s]) AS w FROM m
  UNION ALL SELECT repo, grp, list_transform(used, lambda i: p[i]) FROM m JOIN perm ON n = size AND len(used) = n WHERE chars <= {PERMUTED_CHARS})
SELECT DISTINCT repo, 'reassembled:' || grp AS path, array_to_string(w, '') AS blob FROM ways"""
FRAGMENT_SQL = r"""frag AS (SELECT repo, path, x AS frag, CAST(min(i) - 1 AS INT) AS ord FROM (
  SELECT repo, path, unnest(ms) AS x, generate_subscripts(ms, 1) AS i FROM (SELECT repo, path, regexp_extract_all(content, '[''"]([A-Za-z0-9+/=]{6,200})[''"]', 1) AS ms FROM source_files)) GROUP BY repo, path, x)"""
