"""N-gram Jaccard join (operator 6): documents whose sets of 5-word shingles overlap by 75 % or more.

Linked sets share a token within short prefixes whatever the token order, as
long as it is one order for all.  Candidates must do so under several orders,
all by rarity with different ties: posting lists under the first give pairs,
and prefix sets under the others, which are short, drop pairs before any whole
token set moves.  What is left is compared exactly.

A set can only link if three quarters of its tokens stand in other sets too;
one round of questions over all tokens finds those, and only they go on.
Pairs are made star-wise: in each round a posting list's sets meet a few of
the list, drawn at random, and what links becomes one group.  Then the pairs
of different groups that still share a list are all compared, so no link
between groups is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .graph import components
from .npwords import U64, chain, mix, words

#: One seed for the ties of each token order.
SEEDS = (0x243F_6A88_85A3_08D3, 0x1319_8A2E_0370_7344, 0xA409_3822_299F_31D0)
#: Sets of a list that all others of it meet, by round.
STARS = (4, 8, 8)


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of each distinct shingle, by text and token.  Shorter texts: the whole sequence as one; no words: none."""
    h, at = words(texts)
    count = np.diff(at)
    run = chain(h, n)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    end = np.cumsum(size)
    token = np.empty(end[-1] if len(end) else 0, U64)
    for i, (a, z, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), end.tolist())):
        k = z - a
        if k >= n:
            token[e - k + n - 1:e] = run[a:z - n + 1]
            token[e - k + n - 1:e].sort()
        elif k:
            token[e - 1] = mix(chain(h[a:z], k) ^ U64(k))[0]
    doc = np.repeat(np.arange(len(texts)), size)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], token[new]


def prefix_size(n, percent: int):
    """Tokens of a set of n that must hold one of any set that overlaps by percent."""
    return n - -(-n * percent // 100) + 1


def _count(bucket, kinds, ks, vs):
    """Level of each key: 0 if one document has it, else the bit length of the number of others."""
    u, place = B.merged(ks)
    n = np.zeros(len(u), np.int64)
    for p, v in zip(place, vs):
        n[p] += v.view("<u4").ravel()
    level = np.where(n > 1, np.floor(np.log2(np.maximum(n - 1, 1))) + 1, 0).astype(np.uint8)
    return [level[p][:, None] for p in place], None, None


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rare_prefix(tokens: np.ndarray, levels: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """Shared tokens in the prefix of one set under the order (level, hash by seed)."""
    key = mix(tokens ^ U64(seed))
    order = np.lexsort((key, levels))[: prefix_size(len(tokens), percent)]
    return tokens[order][levels[order] > 0]


def _compare(test):
    """mapInArrow function over (x, y, values of x, as many of y): the pairs that pass the test, as (x, y)."""
    def run(batches):
        for batch in batches:
            out = []
            x, y, *values = batch.columns
            half = len(values) // 2
            for i in range(batch.num_rows):
                own = [v[i].as_buffer() for v in values]
                if test(own[:half], own[half:]):
                    out.append((x[i].as_py(), y[i].as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["x", "y"])

    return run


def _beside(pairs: DataFrame, about: DataFrame, *names: str) -> DataFrame:
    """pairs with these values of both sides."""
    side = {s: about.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in "xy"}
    return pairs.join(side["y"], "y").join(side["x"], "x").select("x", "y", *[f"{s}_{c}" for s in "xy" for c in names])


def verify(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (x, y) that share prefix tokens under all other orders and whose sets overlap enough, as (a, b)."""
    def prefixes(a, b) -> bool:
        return all(len(np.intersect1d(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), assume_unique=True)) for p, q in zip(a, b))

    def whole(a, b) -> bool:
        return _links(np.frombuffer(a[0], U64), np.frombuffer(b[0], U64), percent)

    left = _beside(pairs, heads, *[f"p{k}" for k in range(1, len(SEEDS))]).mapInArrow(shared.tidy(_compare(prefixes)), "x bigint, y bigint")
    done = _beside(left, sets, "tokens").mapInArrow(shared.tidy(_compare(whole)), "x bigint, y bigint")
    return done.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _possible(n: str, pos: str, m: str, at: str, percent: int) -> str:
    """SQL: sizes agree, and as many tokens can still be common if these places hold the first common one.

    A linked pair passes at its first common token, so it may be dropped at others.
    """
    return (f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m}) and "
            f"{100 + percent}L * least({n} - {pos}, {m} - {at}) >= {percent}L * ({n} + {m})")


def link(sets: DataFrame, percent: int, stars: tuple[int, ...] = STARS) -> DataFrame:
    """Edges (a, b) between ids of sets (id, tokens, levels): enough of them to connect all that are linked."""
    def post(batches):
        for row in B.rows(batches):
            tokens, levels = np.frombuffer(row["tokens"], U64), np.frombuffer(row["levels"], np.uint8)
            p = _rare_prefix(tokens, levels, SEEDS[0], percent)
            if len(p):
                first = int((levels == 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(np.full(len(p), row["id"], np.int64)), pa.array(np.full(len(p), len(tokens), np.int32)),
                                                  pa.array(np.arange(first, first + len(p), dtype=np.int32))], ["token", "id", "n", "pos"])

    def heads_of(batches):
        for row in B.rows(batches):
            tokens, levels = np.frombuffer(row["tokens"], U64), np.frombuffer(row["levels"], np.uint8)
            # 32 bits of a token: a clash lets a pair pass to the exact comparison, it drops none
            made = [np.unique((_rare_prefix(tokens, levels, s, percent) >> U64(32)).astype(np.uint32)).tobytes() for s in SEEDS[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([row["id"]], pa.int64()), *[pa.array([x], pa.binary()) for x in made]], ["id", *[f"p{k}" for k in range(1, len(SEEDS))]])

    heads = shared.put(sets.mapInArrow(shared.tidy(heads_of), "id bigint" + "".join(f", p{k} binary" for k in range(1, len(SEEDS)))), "heads")
    posts = shared.put(sets.mapInArrow(shared.tidy(post), "token bigint, id bigint, n int, pos int"), "posts")
    several = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    member = shared.put(posts.join(several, "token").withColumn("g", F.col("id")), "member")
    shared.drop(posts)
    edges = None

    def drawn(k: int) -> Column:
        return F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id", "n", "pos", "g")

    seed = 0
    for many in stars:
        lists = member.groupBy("token").agg(F.array(*[F.min(drawn(seed + j)) for j in range(many)]).alias("stars"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
        seed += many
        met = member.join(lists.select("token", F.array_distinct("stars").alias("stars")), "token")
        met = met.select("id", "n", "pos", "g", F.explode("stars").alias("p")).where(f"p.g <> g and {_possible('n', 'pos', 'p.n', 'p.pos', percent)}")
        pairs = met.select(F.least("p.id", "id").alias("x"), F.greatest("p.id", "id").alias("y")).distinct()
        found = shared.put(verify(pairs, heads, sets, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        group = shared.put(components(edges), "groups")
        old, open_lists = member, lists.select("token")
        now = old.drop("g").join(open_lists, "token", "left_semi").join(group, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("g"))
        member = shared.put(now, "member")
        shared.drop(old)
        shared.drop(group)
    other = member.select("token", F.col("id").alias("y"), F.col("n").alias("m_n"), F.col("pos").alias("m_pos"), F.col("g").alias("o"))
    rest = member.join(other, "token").where(f"g <> o and id < y and {_possible('n', 'pos', 'm_n', 'm_pos', percent)}").select(F.col("id").alias("x"), "y").distinct()
    last = shared.put(verify(rest, heads, sets, percent), "links")
    shared.drop(heads)
    shared.drop(member)
    return last if edges is None else edges.unionByName(last)


def _grouped(store: B.Blocks, percent: int, n: int) -> DataFrame:
    """block, row, uid, doc_id, n_shingles, class_uid and group_uid of each row: the least uid with the same set, and of its group."""
    parts = store.parts

    def ask_all(row):
        _, texts = B.unpack_block(row)
        u, c = np.unique(shingles(texts, n)[1], return_counts=True)
        return u, c.astype("<u4").view(np.uint8).reshape(-1, 4)

    levels = shared.put(B.by_block(B.ask(store.df, parts, ask_all, _count), "levels"), "levels")

    def finish(batches):
        for row in B.rows(batches):
            ids, texts = B.unpack_block(row)
            doc, token = shingles(texts, n)
            size = np.bincount(doc, minlength=len(ids))
            order = np.argsort(token)
            fresh = np.ones(len(order), bool)
            fresh[1:] = token[order[1:]] != token[order[:-1]]
            u = token[order[fresh]]
            level = np.empty(len(token), np.uint8)
            level[order] = B.answered(u, row["levels"], parts, 1)[np.cumsum(fresh) - 1, 0]
            held = np.bincount(doc[level > 0], minlength=len(ids))
            alive = (held > 0) & (100 * held >= percent * size)
            start = np.cumsum(size) - size
            seen: set[bytes] = set()
            digests, tokens, found = [], [], []
            for i in range(len(ids)):
                a, b = start[i], start[i] + size[i]
                digest = None
                data = (None, None)
                if alive[i]:
                    whole = token[a:b].tobytes()
                    digest = hashlib.sha256(whole).digest()[:16]
                    if digest not in seen:
                        seen.add(digest)
                        data = (whole, level[a:b].tobytes())
                digests.append(digest)
                tokens.append(data[0])
                found.append(data[1])
            place = np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), row["block"])), pa.array(place, pa.int32()), pa.array(place + row["first"]), pa.array(ids, mask=ids == B.NO_ID),
                pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary()), pa.array(found, pa.binary())],
                ["block", "row", "uid", "doc_id", "n_shingles", "digest", "tokens", "levels"])

    every = shared.put(store.df.join(levels, "block", "left").mapInArrow(
        shared.tidy(finish), "block bigint, row int, uid bigint, doc_id bigint, n_shingles bigint, digest binary, tokens binary, levels binary"), "sets")
    shared.drop(levels)
    classes = every.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("class_uid"))
    # of the copies that blocks have sent, one
    one = every.where("tokens is not null").select("digest", "uid", "tokens", "levels").groupBy("digest").agg(F.min_by(F.struct("tokens", "levels"), "uid").alias("s"))
    sets = shared.put(one.join(classes, "digest").select(F.col("class_uid").alias("id"), "s.tokens", "s.levels"), "sets")
    edges = link(sets, percent)
    group = components(edges)
    named = classes.join(group, classes["class_uid"] == group["id"], "left").select("digest", "class_uid", F.coalesce("component", "class_uid").alias("group_uid"))
    done = shared.put(every.drop("tokens", "levels").join(named, "digest", "left").select(
        "block", "row", "uid", "doc_id", "n_shingles", F.coalesce("class_uid", "uid").alias("class_uid"), F.coalesce("group_uid", "uid").alias("group_uid")), "grouped")
    shared.drop(every)
    shared.drop(sets)
    return done


def group(docs: DataFrame, percent: int = 75, n: int = 5, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of docs.

    class_id: smallest doc_id with the same set; component_id: smallest doc_id
    reachable by links.  Null or wordless texts have no shingles and stand
    alone.  Each row is a document of its own, so repeated rows are copies, and
    rows with one doc_id but different texts are not linked by it.  A null
    doc_id is never the smallest; a group of such rows alone has null for both.
    Other columns of docs are ignored.  An empty table gives none.
    """
    with B.Blocks(docs.select("doc_id", "text"), block_bytes) as store:
        rows = _grouped(store, percent, n)
    least = lambda uid, name: rows.where("n_shingles > 0").groupBy(uid).agg(F.min("doc_id").alias(name))
    out = rows.join(least("class_uid", "_c"), "class_uid", "left").join(least("group_uid", "_g"), "group_uid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("class_id"), F.coalesce("_g", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, percent: int = 75, n: int = 5, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row of each group of ``group``, that with the smallest doc_id (nulls last), with all columns of docs.

    Rows without shingles all stay.  Texts don't travel: blocks are told which of their rows stay.
    """
    with B.Blocks(docs, block_bytes, rest=True) as store:
        rows = _grouped(store, percent, n)
        order = F.struct(F.coalesce("doc_id", F.lit(B.NO_ID)), "uid")
        least = rows.groupBy("group_uid").agg(F.min(order).alias("m"), F.min_by(F.struct("block", "row"), order).alias("at"))
        return shared.put(store.emit(least.select("at.block", "at.row")), "unique")
