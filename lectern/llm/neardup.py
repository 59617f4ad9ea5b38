"""MinHash near-duplicates by a signature-coordinate inverted join.

Every text's set (distinct five-word shingles, hashed to 64 bits) becomes a one-permutation signature: the range
of hashes is divided into ``COORDINATES`` equal parts, and a coordinate's value is the least hash in its part (a
part may be empty). Of the parts that two sets of similarity J fill together, a share J agrees, hypergeometrically
distributed. A *post* is a coordinate with its value; the hash itself says both.

* Classes. Equal sets are one class; all later work is between classes, so exact copies never meet.
* Threshold. A class knows how many coordinates any set of similarity 0.75 must agree in, less ``SIGMAS`` standard
  deviations (``least``): at 0.75 one link in ten thousand is missed, above it far fewer.
* Prefix. Posts are ordered by how many classes hold them, rarest first. Two signatures that agree in ``least``
  places share a post among the ``filled - least + 1`` rarest of each. What a passage that many texts quote puts
  into their signatures is frequent and skipped: it is counted only for pairs that met before.
* Star. All members of a post meet one pivot, the member with the most company: linear in posts. A pair's equal
  coordinates are counted, and from ``least`` on its full sets are compared, exactly. Links become components.
* Fine signature. Only classes that still share a prefix post with another component go on. Their signature gets
  as many coordinates as there are hashes, so that every shingle is a post and the threshold is exact: a pair of sizes
  n and m must agree in t = ceil(75 (n + m) / 175) posts, hence meet at places up to n - t and m - t of
  their orders. Texts that share most of a template or of a common original, yet not enough, have more posts of their
  own than that and do not meet. They meet pivots first, as above, then every pair that is left.
* Rest. A post's members of equal component and size are one cell; classes meet cells, and only cells that
  pass the test of places are opened. No cap, no pair within a component, no link lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, pieces, tasks, tidy
from .components import connected_components
from .textvec import Powers, mix, shingles, words

COORDINATES = 64
SIGMAS = 3.72
PERCENT = 75
#: Bits of the filter that picks the texts of active classes on the map side; it bounds what is broadcast.
FILTER_BITS = 1 << 24
#: A post that holds more than one row in so many is hot: fewer posts than this are, however large the table. They are looked for
#: among the rows of one class in ``LOOKED``; what is taken for hot changes where rows are dealt to, never what is found.
HOT_POSTS = 10_000
LOOKED = 32
LEAST_SEEN = 16

_SALTS = np.random.default_rng(20240611).integers(0, 2**64, 2, np.uint64)


def _sets(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' sets, each in order, one after the other; their sizes; and the rows' numbers of words."""
    h, bounds, _, _ = words(column, powers)
    s, b = shingles(h, bounds)
    sets = [np.unique(s[b[i] : b[i + 1]]) for i in range(len(b) - 1)]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.array([len(x) for x in sets], np.int64), np.diff(bounds)


def _class_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of differently mixed members."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in _SALTS:
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat ^ salt), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posts of all sets, one after the other, and each set's number of filled coordinates."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = ((flat >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)
    first = np.ones(len(flat), bool)
    first[1:] = place[1:] != place[:-1]
    first[bounds[:-1][sizes > 0]] = True
    upto = np.concatenate([[0], np.cumsum(first)])
    return flat[first], upto[bounds[1:]] - upto[bounds[:-1]]


def least_matches(sizes: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Coordinates in which any set of similarity 0.75 agrees with one of these sizes, but for ``SIGMAS`` deviations."""
    j, n, e = PERCENT / 100, sizes.astype(float), filled.astype(float)
    spread = np.sqrt(j * (1 - j) * e * np.maximum(0, n - e) / np.maximum(1, n - 1))
    return np.maximum(1, np.floor(j * e - SIGMAS * spread)).astype(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in pieces(batches):
        flat, sizes, n_words = _sets(batch.column("text"), powers)
        k1, k2 = _class_keys(flat, sizes)
        posts, filled = signatures(flat, sizes)
        ends = pa.array(np.concatenate([[0], np.cumsum(filled)]).astype(np.int32))
        own = [c for c in batch.schema.names if c != "text"]
        found = [pa.array(n_words.astype(np.int64)), pa.array(sizes), pa.array(k1), pa.array(k2), pa.array(least_matches(sizes, filled)), pa.ListArray.from_arrays(ends, pa.array(posts.view(np.int64)))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, own), *found], [*own, "n_words", "n_shingles", "k1", "k2", "least", "posts"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in pieces(batches):
        flat, sizes, _ = _sets(batch.column("text"), powers)
        k1, k2 = _class_keys(flat, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        members = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(members, pa.binary())], ["k1", "k2", "members"])


def _sets_of(texts: DataFrame, active: DataFrame) -> DataFrame:
    """Sets of the texts whose doc_id an active class goes by; a bitmap of fixed size drops most others unshuffled."""
    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(FILTER_BITS))
    words_ = active.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[words_.column("word").to_numpy()] = words_.column("bits").to_numpy().astype(np.uint32)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("slot").to_numpy()
                keep = (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1
                if keep.any():
                    yield batch.filter(pa.array(keep.astype(bool)))

        return _set_rows(wanted())

    return texts.select(slot.alias("slot"), "text").mapInArrow(picked, "k1 long, k2 long, members binary")


def _fine_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of each set, a few sets at a time."""
    for batch in pieces(batches, "members"):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("members")]
        sizes = np.array([len(x) for x in sets], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(), sizes)), pa.array(np.concatenate(sets))], ["cid", "post"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = []
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            both = np.concatenate([np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= PERCENT * (len(both) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _hot(posts: DataFrame) -> DataFrame:
    """``(post, often)``: posts that a large share of all classes hold, and about how many do.

    Prefixes need one order for all classes, whichever it is, so an estimate serves as well as a count.
    """
    seen = cut(posts.where(F.pmod(F.xxhash64("cid"), F.lit(LOOKED)) == 0).groupBy("post").agg(F.count("*").alias("n")))
    total = seen.agg(F.sum("n")).first()[0] or 0
    return seen.where((F.col("n") >= LEAST_SEEN) & (F.col("n") * HOT_POSTS > total)).select("post", (F.col("n") * LOOKED).alias("often"))


def _prefixes(posts: DataFrame, classes: DataFrame) -> DataFrame:
    """``posts(cid, post)``, ``classes(cid, n, least, filled)`` -> ``(cid, n, company, post, hot, pos)``, prefix posts that others hold.

    ``pos`` is the post's place in the class's order, ``company`` how often the class's posts are held in all.
    """
    hot = _hot(posts)
    salt = F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("cid"), F.lit(tasks(posts.sparkSession)))).otherwise(0)
    # a window, so that one exchange and one sort serve the count and its rows; a hot post is dealt over all tasks and goes by its estimate
    posts = posts.join(F.broadcast(hot), "post", "left").withColumn("salt", salt)
    shared = posts.withColumn("df", F.coalesce("often", F.count("*").over(Window.partitionBy("post", "salt")))).where("df > 1")
    held = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "post", F.col("often").isNotNull().alias("hot")))).alias("held")).join(classes, "cid")
    # posts that no other class holds are the rarest and take the first places; sums come before the explode, else each of its rows makes them anew
    summed = held.select(
        "cid",
        "n",
        F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + x["df"]).alias("company"),
        (F.col("filled") - F.size("held")).alias("own"),
        F.slice("held", 1, F.greatest(F.lit(0), F.size("held") - F.col("least") + 1)).alias("prefix"),
    )
    return summed.select("cid", "n", "company", "own", F.posexplode("prefix").alias("i", "x")).select("cid", "n", "company", F.col("x.post").alias("post"), F.col("x.hot").alias("hot"), (F.col("own") + F.col("i")).alias("pos"))


def _places(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether a post at these places of sets of these sizes can be the first common one of a link."""
    t = F.floor((PERCENT * (n + m) + 99 + PERCENT) / F.lit(100 + PERCENT))
    return (pos <= n - t) & (at <= m - t)


def _sizes(n: Column, pos: Column, m: Column, at: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _met(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows(post, hot, ...)``, which are stored, with the one line of their post in ``lines(post, hot, ...)``.

    Rows of hot posts, fewer than ``HOT_POSTS``, meet it by broadcast where they lie; no task gets all rows of such a post.
    """
    cold = rows.where("not hot").join(lines.where("not hot").drop("hot"), "post")
    return cold.unionByName(rows.where("hot").join(F.broadcast(lines.where("hot").drop("hot")), "post"))


class _Links:
    """The link graph between classes as far as it is known."""

    def __init__(self, classes: DataFrame, texts: DataFrame, exact: bool = False) -> None:
        self.links: DataFrame | None = None
        self.known: DataFrame | None = None
        self.posts: DataFrame | None = None
        full = classes.where("n_shingles > 0")
        # 32 bits of a post, its coordinate among them, are enough to count by
        short = F.transform("posts", lambda x: F.shiftright(x, 32).cast("int"))
        if exact:
            active = cut(full.select("cid", "k1", "k2", "doc_id", "n_shingles", F.lit(0).alias("least"), short.alias("signature")))
        else:
            own = full.select("cid", F.col("n_shingles").alias("n"), "least", F.size("posts").alias("filled"))
            self.posts = cut(self._open(cut(_prefixes(full.select("cid", F.explode("posts").alias("post")), own))))
            active = cut(self.posts.select("cid").distinct().join(classes, "cid").select("cid", "k1", "k2", "doc_id", "n_shingles", "least", short.alias("signature")))
        sets = _sets_of(texts, active).groupBy("k1", "k2").agg(F.first("members").alias("members"))
        self.signatures = active.select("cid", "least", "signature")
        self.sets = cut(active.select("cid", "k1", "k2", F.col("n_shingles").alias("n")).join(sets, ["k1", "k2"]).select("cid", "n", "members"))
        tidy(classes.sparkSession)

    @staticmethod
    def _open(posts: DataFrame) -> DataFrame:
        """Posts that several components hold, each class its own."""
        held = posts.groupBy("post", "hot").agg(F.count("*").alias("k")).where("k > 1").select("post", "hot")
        return _met(posts, held).withColumn("component", F.col("cid"))

    def parts(self) -> DataFrame | None:
        """``(node, component)`` of the classes that have links by now."""
        if self.known is None and self.links is not None:
            self.known = connected_components(self.links)
        return self.known

    def labelled(self, posts: DataFrame) -> DataFrame:
        """``posts`` with the component of each class, only of posts that several components hold."""
        parts = self.parts()
        if parts is None:
            return posts
        now = posts.drop("component").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        now = cut(now)
        several = now.groupBy("post", "hot").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("post", "hot")
        out = cut(_met(now, several))
        discard(now)
        return out

    def confirm(self, pairs: DataFrame) -> None:
        """Count equal coordinates, then compare full sets; adds what holds to the links."""
        s, t = (self.signatures.select(F.col("cid").alias(c), F.col("least").alias(f"least_{c}"), F.col("signature").alias(n)) for c, n in (("a", "s"), ("b", "t")))
        left, right = (self.sets.select(F.col("cid").alias(c), F.col("members").alias(n)) for c, n in (("a", "left"), ("b", "right")))
        # signatures first: sets travel only for pairs that reach the threshold
        matches = F.size(F.array_intersect("s", "t"))
        near = pairs.join(s, "a").join(t, "b").where(matches >= F.greatest("least_a", "least_b")).select("a", "b")
        found = near.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirmed, "a long, b long")
        old, self.links = self.links, cut(found if self.links is None else found.union(self.links))
        discard(old, self.known)
        self.known = None

    @staticmethod
    def star(labelled: DataFrame, fits) -> DataFrame:
        """Each class with the pivots of its posts, as far as these are of other components."""
        top = labelled.groupBy("post", "hot").agg(F.max_by(F.struct("cid", "n", "pos", "component"), F.struct("company", "cid")).alias("p"))
        met = _met(labelled, top).where((F.col("component") != F.col("p.component")) & fits(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
        return met.select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b")).distinct()

    @staticmethod
    def rest(labelled: DataFrame, fits) -> DataFrame:
        """Every pair of different components that meets at fitting places; the larger class looks for smaller or equal ones."""
        # rows of a hot post are dealt over all tasks, and so its cells are there in each
        deal = tasks(labelled.sparkSession)
        cells = labelled.groupBy("post", "hot", F.col("component").alias("other"), F.col("n").alias("m")).agg(F.min("pos").alias("low"))
        cells = cells.select("post", "other", "m", "low", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(deal - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        seekers = labelled.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("cid"), F.lit(deal))).otherwise(0).cast("int"))
        opened = seekers.join(cells, ["post", "salt"]).where((F.col("m") <= F.col("n")) & (F.col("component") != F.col("other")) & fits(F.col("n"), F.col("pos"), F.col("m"), F.col("low")))
        opened = opened.select("post", "other", "m", F.col("cid").alias("a"), F.col("n").alias("n"), "pos")
        members = labelled.select("post", F.col("component").alias("other"), F.col("n").alias("m"), F.col("cid").alias("b"), F.col("pos").alias("at"))
        met = opened.join(members, ["post", "other", "m"]).where(((F.col("m") < F.col("n")) | (F.col("b") < F.col("a"))) & fits(F.col("n"), F.col("pos"), F.col("m"), F.col("at")))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def fine(self, labelled: DataFrame) -> DataFrame:
        """Posts of the fine signature of the classes that are still open."""
        sets = self.sets.join(labelled.select("cid").distinct(), "cid")
        exact = F.floor((PERCENT * F.col("n") + 99) / F.lit(100)).cast("int")
        return cut(self._open(cut(_prefixes(sets.select("cid", "members").mapInArrow(_fine_posts, "cid long, post long"), self.sets.select("cid", "n", exact.alias("least"), F.col("n").alias("filled"))))))

    def find(self) -> DataFrame | None:
        """``(node, component)`` of all classes that have links."""
        if self.posts is None:
            fine = self.fine(self.signatures)
        else:
            self.confirm(self.star(self.posts, _sizes))
            fine = self.fine(self.labelled(self.posts))
        self.confirm(self.star(self.labelled(fine), _places))
        self.confirm(self.rest(self.labelled(fine), _places))
        return self.parts()


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Words are maximal runs of non-white-space, A-Z lower-cased. A null text, or one without words, has an
    empty set: it links with nothing, its component is its own doc_id. Fewer than five words make one
    shingle, so such texts link only with equal sequences. Rows that share a doc_id share no more than that:
    each is linked by its own text. A null doc_id takes part like any other but is never a component's
    name, and is kept only where a component has no doc_id at all (component_id is null then). Other
    columns are ignored, whatever their names. An empty table gives an empty table.

    Signatures may lose a link at similarity 0.75 itself, one in ten thousand (``SIGMAS``). With ``exact`` every class goes by its
    fine signature alone and none is lost, at the price of a post for each shingle. Components wider than ``connected_components`` settles raise.
    """
    return near_components(docs, exact=exact).select("doc_id", "n_shingles", "component_id", "kept")


def near_components(docs: DataFrame, carried: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """``near_duplicates`` with the ``carried`` columns of each row, ``n_words``, and ``component``, which tells components
    apart where ids do not: 128 bits that depend on the component's sets alone, null for an empty set.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))
    texts = own.select("doc_id", "text")
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in own.drop("text").schema)
    base = cut(own.mapInArrow(_signed, f"{kinds}, n_words long, n_shingles long, k1 long, k2 long, least int, posts array<long>"))
    full = base.where("n_shingles > 0")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "least", "posts")]
    classes = cut(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), *firsts).select(F.monotonically_increasing_id().alias("cid"), "*"))
    parts = _Links(classes, texts, exact).find()
    named = classes.select("cid", "k1", "k2", "doc_id").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("k1", "k2")).alias("name"))
    named = named.join(names, "component").select("k1", "k2", "component_id", "name")
    out = base.drop("posts", "least").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    name = F.when(F.col("n_shingles") > 0, F.col("name"))
    return out.select("doc_id", *carried, "n_words", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), name.alias("component"))
