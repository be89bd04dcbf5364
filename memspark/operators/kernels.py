"""Numpy kernels that run inside one bounded cell. Shipped to tasks by value."""

from __future__ import annotations

import itertools
import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 256
#: Similarities worked out at once.
CHUNK_SIMS = 1 << 20


def stack(values) -> np.ndarray:
    """Vectors of one length as float64 rows of unit length; zero vectors stay zero."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def best(scores: np.ndarray, order: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Places of the k best scores at or above the floor, equal scores by ``order``."""
    at = np.flatnonzero(scores >= floor)
    if len(at) > k:
        cut = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= cut]
    return at[np.lexsort((order[at], -scores[at]))][:k]


def repeat_heads(heads: list[str], found: list[tuple], values: list[str]) -> pd.DataFrame:
    """(head values, array, array) items as one frame, the head repeated for every value."""
    sizes = [len(a) for _, a, _ in found]
    cols = {c: np.repeat(np.asarray([h[i] for h, _, _ in found]), sizes) for i, c in enumerate(heads)}
    cols[values[0]] = np.concatenate([a for _, a, _ in found])
    cols[values[1]] = np.concatenate([b for _, _, b in found])
    return pd.DataFrame(cols)


def empty() -> pd.DataFrame:
    """No rows; Spark takes the types from the declared schema."""
    return pd.DataFrame()


def by_length(frame: pd.DataFrame, column: str) -> dict[int, pd.DataFrame]:
    sizes = frame[column].map(lambda v: 0 if v is None else len(v))
    return {int(n): g.reset_index(drop=True) for n, g in frame.groupby(sizes) if n > 0}


def best_groups(sims: np.ndarray, sizes: np.ndarray, starts: np.ndarray, codes: np.ndarray, k: int, floor: float, digits: int, banned: int):
    """The k best groups (number, rounded similarity) of the vectors at ``sims``; vector i is of the groups ``codes[starts[i]:]``.

    Only the nearest vectors are looked at: twice, four times as many, until they are of k groups.
    """
    slack = 2 * 10.0**-digits
    need = n = k + (banned >= 0)
    while True:
        least, whole, some = floor - slack, True, sims[::8]
        # the n-th best of some vectors is a floor for the n-th best of all
        if len(some) > n and (cut := np.partition(some, len(some) - n)[len(some) - n] - slack) > least:
            least, whole = cut, False
        at = np.flatnonzero(sims >= least)
        if len(at) > n and (cut := np.partition(sims[at], len(at) - n)[len(at) - n] - slack) > least:
            at, whole = at[sims[at] >= cut], False
        near = np.round(sims[at], digits)
        full = near[sizes[at] >= need]
        if len(full):  # one vector of enough groups: nothing farther counts
            at, near, whole = at[near >= full.max()], near[near >= full.max()], True
        count = sizes[at]
        entry = np.arange(count.sum()) + np.repeat(starts[at] - np.cumsum(count) + count, count)
        group, sim = codes[entry], np.repeat(near, count)
        order = np.lexsort((group, -sim))
        first = np.sort(np.unique(group[order], return_index=True)[1])
        if whole or len(first) >= need:
            break
        n *= 4
    order = order[first]
    order = order[(group[order] != banned) & (sim[order] >= floor)][:k]
    return group[order], sim[order]


def vector_best(keys: list[str], query_cols: list[str], group: str, k: str, digits: int, exclude_self: bool):
    """Per query row: its k best groups by the highest cosine of any of the group's vectors (``_groups`` of each vector)."""
    columns = [*keys, *query_cols, group, "sim"]

    def run(vecs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_len = by_length(vecs, "vector")
        for n, qs in by_length(queries, "query_vector").items():
            vs = by_len.get(n)
            if vs is None:
                continue
            sizes = vs["_groups"].map(len).to_numpy()
            starts = np.cumsum(sizes) - sizes
            codes, uniques = pd.factorize(np.concatenate(list(vs["_groups"])), sort=True)
            names, where = np.asarray(uniques), pd.Index(uniques)
            unit = stack(vs["vector"])
            own = where.get_indexer(qs["self_id"]) if exclude_self else np.full(len(qs), -1)
            heads = list(zip(*[qs[c] for c in (*keys, *query_cols)]))
            limits, floors = qs[k].to_numpy(), qs["threshold"].to_numpy(dtype=np.float64)
            step = max(1, CHUNK_SIMS // len(unit))
            for lo in range(0, len(qs), step):
                sims = stack(qs["query_vector"].iloc[lo : lo + step]) @ unit.T
                for i, values in enumerate(sims, lo):
                    top, sim = best_groups(values, sizes, starts, codes, int(limits[i]), floors[i], digits, own[i])
                    if len(top):
                        out.append((heads[i], names[top], sim))
        return repeat_heads([*keys, *query_cols], out, [group, "sim"])[columns] if out else empty()

    return run


class Postings:
    """Postings of one cell ordered by term, so the documents of a term are one slice."""

    def __init__(self, frame: pd.DataFrame, vocab: pd.Index, numbers: list[str]):
        codes = vocab.get_indexer(frame["term"])
        order = np.argsort(codes, kind="stable")
        order = order[codes[order] >= 0]
        self.docs, names = pd.factorize(frame["doc_id"].to_numpy()[order], sort=True)
        self.names = np.asarray(names)
        self.values = {c: frame[c].to_numpy(dtype=np.float64)[order] for c in numbers}
        self.bounds = np.searchsorted(codes[order], np.arange(len(vocab) + 1))


def top_documents(post: Postings, spans: np.ndarray, query: np.ndarray, gain, limit: np.ndarray, digits: int, banned=None):
    """(query number, document number, score) of each query's best documents.

    ``spans`` and ``query`` give term and query of every asked term, queries in one run each;
    ``gain(rows, places)`` is what asked term ``rows`` adds to posting ``places``; ``limit`` and
    ``banned`` (document numbers or None) stand per query. Queries that touch much of the cell are
    summed over all its documents, the others together by sorting what they touch.
    """
    n_docs = len(post.names)
    starts, counts = post.bounds[spans], post.bounds[spans + 1] - post.bounds[spans]
    cuts = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True])
    touched = np.add.reduceat(counts, cuts[:-1]) if len(query) else np.zeros(0, dtype=np.int64)
    every = np.arange(n_docs)
    found: list[tuple] = []

    def places(lo, hi):
        c = counts[lo:hi]
        rows = np.repeat(np.arange(lo, hi), c)
        return rows, np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(starts[lo:hi], c)

    def sparse(lo, hi):
        rows, at = places(lo, hi)
        keys, where = np.unique(query[rows] * n_docs + post.docs[at], return_inverse=True)
        # without any posting numpy counts in whole numbers
        score = np.round(np.bincount(where, gain(rows, at)).astype(np.float64), digits)
        q, d = keys // n_docs, keys % n_docs
        if banned is not None:
            asked = range(query[lo], query[hi - 1] + 1)
            out = [n * n_docs + banned[n] for n in asked if banned[n] is not None]
            if out:
                score[np.isin(keys, np.concatenate(out))] = -np.inf
        order = np.lexsort((d, -score, q))
        q, d, score = q[order], d[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = (rank < limit[q]) & (score > -np.inf)
        found.append((q[keep], d[keep], score[keep]))

    def dense(lo, hi):
        rows, at = places(lo, hi)
        total = np.bincount(post.docs[at], gain(rows, at), minlength=n_docs)
        n = query[lo]
        shown = np.where(total > 0, np.round(total, digits), -np.inf)
        if banned is not None and banned[n] is not None:
            shown[banned[n]] = -np.inf
        top = best(shown, every, int(limit[n]), 0.0)
        found.append((np.full(len(top), n), top, shown[top]))

    run_lo, run_n = None, 0
    for i in range(len(touched)):
        lo, hi = cuts[i], cuts[i + 1]
        if touched[i] * 4 >= n_docs:
            if run_lo is not None:
                sparse(run_lo, lo)
                run_lo, run_n = None, 0
            dense(lo, hi)
            continue
        run_lo, run_n = (lo, touched[i]) if run_lo is None else (run_lo, run_n + touched[i])
        if run_n > 1 << 21:
            sparse(run_lo, hi)
            run_lo, run_n = None, 0
    if run_lo is not None:
        sparse(run_lo, len(query))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3


def counted_words(asked: list[int] | None):
    """Pandas UDF: how many hashed terms a text has, its different ones (the ``asked`` ones only) and how often each occurs."""
    from pyspark.sql import functions as F

    wanted = None if asked is None else np.sort(np.asarray(asked, dtype=np.int64))

    @F.pandas_udf("doc_len int, words array<bigint>, tfs array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        words, tfs = [], []
        for t in texts:
            w, n = np.unique(np.asarray(() if t is None else t, dtype=np.int64), return_counts=True)
            if wanted is not None:
                keep = np.searchsorted(wanted, w, "right") > np.searchsorted(wanted, w)
                w, n = w[keep], n[keep]
            words.append(w)
            tfs.append(n.astype(np.int32))
        return pd.DataFrame({"doc_len": pd.array([None if t is None else len(t) for t in texts], dtype="Int32"), "words": words, "tfs": tfs})

    return count


def bm25_best(keys: list[str], digits: int, b: float, k1: float):
    """Per query: its k best documents of the cell by BM25 under the query's own statistics.

    A document is a row of ``words`` and ``tfs``, a query one of ``words`` and ``weights``. The documents of a word are one
    slice, and a query adds its words' slices up over all documents of the cell.
    """

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or asked.empty:
            return empty()
        number, names = pd.factorize(docs["doc_id"], sort=True)
        names, n_docs = np.asarray(names), len(names)
        repeated = n_docs < len(docs)
        sizes = docs["words"].map(len).to_numpy()
        said = np.concatenate(list(asked["words"]))
        known, term = np.unique(said, return_inverse=True)
        words = np.concatenate(list(docs["words"]))
        code = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[code] == words
        order = np.flatnonzero(hit)[np.argsort(code[hit], kind="stable")]
        bounds = np.searchsorted(code[order], np.arange(len(known) + 1))
        post = np.repeat(number, sizes)[order]
        tf = np.concatenate(list(docs["tfs"]))[order].astype(np.float64)
        length = np.repeat(docs["doc_len"].to_numpy(dtype=np.float64), sizes)[order]
        del words, code, hit, order

        def saturated(tf, length, avg):
            return tf / (tf + k1 * ((1 - b) + b * length / avg if b else 1.0))

        avgs = asked["avg_len"].to_numpy()
        part = saturated(tf, length, avgs[0]) if (avgs == avgs[0]).all() else None
        begin, end = bounds[:-1].tolist(), bounds[1:].tolist()
        skips = asked["skip"] if "skip" in asked else [None] * len(asked)
        slack, found, total, at = 2 * 10.0**-digits, [], np.zeros(n_docs), 0
        place = pd.Index(names)
        for i, (weights, k, avg, skip) in enumerate(zip(asked["weights"], asked["k"], avgs, skips)):
            total[:] = 0.0
            for t, w in zip(term[at : at + len(weights)].tolist(), weights.tolist()):
                lo, hi = begin[t], end[t]
                if lo == hi:
                    continue
                gain = w * (part[lo:hi] if part is not None else saturated(tf[lo:hi], length[lo:hi], avg))
                if repeated:
                    np.add.at(total, post[lo:hi], gain)
                else:
                    total[post[lo:hi]] += gain
            at += len(weights)
            if skip is not None and len(skip):
                gone = place.get_indexer(skip)
                total[gone[gone >= 0]] = 0.0
            k, some = int(k), total[::8]
            # the k-th best of some documents is a floor for the k-th best of all
            floor = np.partition(some, len(some) - k)[len(some) - k] - slack if len(some) > k else 0.0
            top = np.flatnonzero(total > max(floor, 0.0))
            score = np.round(total[top], digits)
            first = best(score, top, k, 0.0)
            if len(first):
                found.append((i, top[first], score[first]))
        if not found:
            return empty()
        query = np.repeat([i for i, _, _ in found], [len(t) for _, t, _ in found])
        top, score = (np.concatenate(x) for x in list(zip(*found))[1:])
        head = {c: docs[c].iloc[0] for c in keys}
        return pd.DataFrame({**head, "query_id": asked["query_id"].to_numpy()[query], "doc_id": names[top], "score": score})

    return run


def packed_tokens():
    """Pandas UDF: texts, each token of them ended by a zero, packed by zlib."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else zlib.compress(t.encode(), 6))

    return pack


def mmr_order(lam: float):
    """Pandas UDF: positions picked from (relevances, packed token sets, k), best first."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def order(relevances: pd.Series, tokens: pd.Series, ks: pd.Series) -> pd.Series:
        def one(rel, packed, k):
            rel = np.asarray(rel, dtype=np.float64)
            n = len(rel)
            if k >= n:
                return np.argsort(-rel, kind="stable")
            sets = [zlib.decompress(p) for p in packed]
            size = np.asarray([s.count(b"\0") for s in sets])
            words = b"".join(sets).split(b"\0")[:-1]
            # a word goes by the place where it stands first
            code = np.fromiter(map({}.setdefault, words, itertools.count()), np.int64, len(words))
            owner, stop = np.repeat(np.arange(n), size), np.cumsum(size)
            nearest, free, picked = np.zeros(n), np.ones(n, dtype=bool), []
            for _ in range(k):
                gain = np.where(free, lam * rel - (1 - lam) * nearest, -np.inf)
                at = int(gain.argmax())
                picked.append(at)
                free[at] = False
                mark = np.zeros(len(words))
                mark[code[stop[at] - size[at] : stop[at]]] = 1
                shared = np.bincount(owner, mark[code], n)
                union = size + size[at] - shared
                nearest = np.maximum(nearest, np.divide(shared, union, out=np.zeros(n), where=shared > 0))
            return np.asarray(picked)

        return pd.Series([one(r, t, int(k)) for r, t, k in zip(relevances, tokens, ks)])

    return order


def similar_forest(keys: list[str], threshold: float, digits: int):
    """Edges of a spanning forest of the pairs at or above the threshold.

    Joining each cell's pairs and keeping one tree per joined part loses no connection, and a cell
    of n rows returns fewer than n edges however many pairs are alike.
    """
    columns = [*keys, "src", "dst"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_len = by_length(right, "vector")
        for n, ls in by_length(left, "vector").items():
            rs = by_len.get(n)
            if rs is None:
                continue
            ids = pd.Index(pd.unique(np.concatenate([ls["id"].to_numpy(), rs["id"].to_numpy()])))
            li, ri = ids.get_indexer(ls["id"]), ids.get_indexer(rs["id"])
            label, edges, unit = np.arange(len(ids)), [], stack(rs["vector"])
            for lo in range(0, len(ls), CHUNK):
                alike = np.round(stack(ls["vector"].iloc[lo : lo + CHUNK]) @ unit.T, digits) >= threshold
                for a in np.flatnonzero(alike.any(axis=1)):
                    own = li[lo + a]
                    near = ri[alike[a]]
                    # one step for each part that joins, however many pairs are alike
                    while len(near := near[label[near] != label[own]]):
                        edges.append((own, near[0]))
                        label[label == label[near[0]]] = label[own]
            if edges:
                e = np.asarray(edges)
                head = {c: left[c].iloc[0] for c in keys}
                out.append(pd.DataFrame({**head, "src": ids.to_numpy()[e[:, 0]], "dst": ids.to_numpy()[e[:, 1]]}))
        return pd.concat(out)[columns] if out else empty()

    return run


def merge_centroids(cap: int):
    """Merge the two most alike clusters of a group, again and again, until ``cap`` are left.

    Every merge depends on the one before. Each cluster remembers its closest later cluster, so the
    pass needs one row per cluster in memory, not one per pair.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("cluster").reset_index(drop=True)
        names = list(g["cluster"])
        m = np.stack([np.asarray(v, dtype=np.float32) for v in g["centroid"]])
        unit = stack(m)
        n = len(names)
        into = list(range(n))
        alive = np.ones(n, dtype=bool)
        partner, score = np.full(n, -1), np.full(n, -np.inf)

        def refresh(i):
            sims = np.where(alive[i + 1 :], unit[i + 1 :] @ unit[i], -np.inf)
            partner[i], score[i] = -1, -np.inf
            if len(sims) and sims.max() > -np.inf:
                j = int(sims.argmax())
                partner[i], score[i] = i + 1 + j, sims[j]

        if n > cap:
            for i in range(n):
                refresh(i)
        while alive.sum() > cap:
            a = int(np.where(alive, score, -np.inf).argmax())
            b = int(partner[a])
            into[b], alive[b] = a, False
            m[a] = (m[a] + m[b]) / np.float32(2)
            unit[a] = stack([m[a]])[0]
            for i in np.flatnonzero(alive):
                if i == a or partner[i] == a or partner[i] == b:
                    refresh(i)
                elif i < a:
                    s = float(unit[i] @ unit[a])
                    if s > score[i] or (s == score[i] and a < partner[i]):
                        partner[i], score[i] = a, s

        def final(i):
            while into[i] != i:
                i = into[i]
            return names[i]

        head = {c: g[c] for c in ("scope_kind", "scope_owner", "day")}
        return pd.DataFrame({**head, "cluster": g["cluster"], "merged": [final(i) for i in range(n)]})

    return run


#: Below every date, and below what starts without one.
NO_DAY = -(1 << 40)


def days(dates: pd.Series, missing: int) -> np.ndarray:
    """Dates as day numbers."""
    known = pd.to_datetime(dates, errors="coerce")
    numbers = known.to_numpy("datetime64[D]").astype(np.int64)
    return np.where(known.isna().to_numpy(), missing, numbers)


def as_dates(numbers: np.ndarray) -> list:
    return numbers.astype("datetime64[D]").astype(object).tolist()


class Ahead:
    """First place at or after another whose object differs and whose start is late enough.

    Stretches of 2, 4, 8 ... places are summed up by their largest start, its object, and the largest
    start of the other objects; stretches that cannot hold an answer are jumped over.
    """

    def __init__(self, start: np.ndarray, obj: np.ndarray, second: np.ndarray | None = None):
        self.levels = [(start, obj, np.full(len(start), NO_DAY) if second is None else second)]
        size = 1
        while 2 * size <= len(start):
            self.levels.append(self._joined(*((x[:-size] for x in self.levels[-1])), *((x[size:] for x in self.levels[-1]))))
            size *= 2

    @staticmethod
    def _joined(start, obj, second, start_b, obj_b, second_b):
        front = start >= start_b
        top, rest = np.where(front, obj, obj_b), np.where(front, second, second_b)
        lower, lower_obj, lower_rest = np.where(front, start_b, start), np.where(front, obj_b, obj), np.where(front, second_b, second)
        return np.maximum(start, start_b), top, np.maximum(rest, np.where(lower_obj == top, lower_rest, lower))

    def first(self, begin: np.ndarray, end: np.ndarray, obj: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places, or ``end`` where there is none."""
        at = begin.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start, own, second = self.levels[k]
            fits = np.flatnonzero(at + (1 << k) <= end)
            p = at[fits]
            late = np.where(own[p] == obj[fits], second[p], start[p])
            at[fits[late < least[fits]]] += 1 << k
        return at


def close_in_bucket(keys: list[str]):
    """Open edges of a bucket with the edge of the same bucket that ends them, or ``asks`` where it may lie in a later one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at").reset_index(drop=True)
        n, at = len(rows), rows["at"].to_numpy()
        new = np.zeros(n, bool)
        for c in keys:
            codes = pd.factorize(rows[c])[0]
            new[1:] |= codes[1:] != codes[:-1]
        stops = np.r_[np.flatnonzero(new), n]
        end = stops[np.searchsorted(stops, np.arange(n), "right")]
        obj = pd.factorize(rows["object_id"])[0]
        start = days(rows["valid_from"], NO_DAY + 1)
        ahead = Ahead(np.where(rows["ends"].to_numpy(bool), start, NO_DAY), obj)
        q = np.flatnonzero(rows["open"].to_numpy(bool))
        found = ahead.first(q + 1, end[q], obj[q], start[q])
        got = found < end[q]
        keep = got | (end[q] == n)
        q, found, got = q[keep], np.minimum(found[keep], n - 1), got[keep]
        ended = [d if g else None for d, g in zip(as_dates(start[found]), got)]
        return pd.DataFrame({"at": at[q], "end_at": at[found], "end_from": pd.Series(ended, dtype=object), "asks": ~got})

    return run


def closing_bucket(keys: list[str], sums: pd.DataFrame):
    """Asking edges with ``bucket`` replaced by the first later one that holds an edge to end them; others leave."""
    sums = sums.assign(most=days(sums["most"], NO_DAY)).sort_values([*keys, "bucket", "most"], ascending=[True] * (len(keys) + 1) + [False])
    lines = {}
    for key, rows in sums.groupby(keys, sort=False):
        codes, names = pd.factorize(rows["object_id"])
        first = ~rows["bucket"].duplicated().to_numpy()
        buckets = rows["bucket"].to_numpy()[first]
        second = np.full(len(buckets), NO_DAY)
        place = np.cumsum(first) - 1
        second[place[~first]] = rows["most"].to_numpy()[~first]
        lines[key] = (buckets, pd.Index(names), Ahead(rows["most"].to_numpy()[first], codes[first], second))

    def run(batches):
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                if key not in lines:
                    continue
                buckets, names, ahead = lines[key]
                begin = np.searchsorted(buckets, rows["bucket"].to_numpy(), "right")
                end = np.full(len(rows), len(buckets))
                found = ahead.first(begin, end, names.get_indexer(rows["object_id"]), days(rows["valid_from"], NO_DAY + 1))
                got = found < end
                yield rows[got].assign(bucket=buckets[found[got]])

    return run


def close_in_cell():
    """Asking edges with the first edge of a later bucket that ends them."""

    def run(ends: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if ends.empty or asks.empty:
            return empty()
        ends = ends.sort_values("at")
        codes, names = pd.factorize(ends["object_id"])
        start, at = days(ends["valid_from"], NO_DAY), ends["at"].to_numpy()
        stop = np.full(len(asks), len(ends))
        found = Ahead(start, codes).first(np.zeros(len(asks), np.int64), stop, pd.Index(names).get_indexer(asks["object_id"]), days(asks["valid_from"], NO_DAY + 1))
        got = found < stop
        found = found[got]
        return pd.DataFrame({"at": asks["at"].to_numpy()[got], "end_at": at[found], "end_from": pd.Series(as_dates(start[found]), dtype=object)})

    return run


def count_matches():
    """Per query, how many documents of the cell hold at least one of its terms."""

    def run(postings: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        docs_of = {t: g.to_numpy() for t, g in postings.groupby("term")["doc_id"]}
        out = []
        for qid, words in terms.groupby("query_id")["term"]:
            hit = [docs_of[w] for w in words if w in docs_of]
            if hit:
                out.append((qid, len(np.unique(np.concatenate(hit)))))
        return pd.DataFrame(out, columns=["query_id", "n"]) if out else empty()

    return run


def specific_best(keys: list[str], top: int):
    """Per query: the related documents with the highest summed weights, newer ones first on ties."""

    def run(postings: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        if postings.empty or terms.empty:
            return empty()
        docs = postings.drop_duplicates("doc_id").sort_values(["created_at", "doc_id"], ascending=[False, True])
        place = pd.Index(docs["doc_id"])
        vocab = pd.Index(terms["term"].unique())
        # documents go by their place in the order of ties
        post = Postings(postings.assign(doc_id=place.get_indexer(postings["doc_id"])), vocab, ["weight"])
        t = terms.sort_values("query_id", kind="stable")
        query, qids = pd.factorize(t["query_id"].to_numpy())
        own = pd.Index(post.names).get_indexer(place.get_indexer(qids))
        banned = [None if o < 0 else np.asarray([o]) for o in own]
        weight = post.values["weight"]
        q, d, score = top_documents(post, vocab.get_indexer(t["term"]), query, lambda rows, at: weight[at], np.full(len(qids), top), 9, banned)
        if not len(q):
            return empty()
        picked = docs.iloc[post.names[d]]
        head = {c: postings[c].iloc[0] for c in keys}
        return pd.DataFrame({**head, "query_id": np.asarray(qids)[q], "doc_id": picked["doc_id"].to_numpy(), "created_at": picked["created_at"].to_numpy(), "score": score})

    return run
