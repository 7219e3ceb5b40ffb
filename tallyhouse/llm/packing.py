"""Packing documents into sequences by vector bin packing.

An item has three amounts: tokens, segments and loss-bearing tokens; a sequence has a limit on each. The dot-product
heuristic (Panigrahy et al., 2011) fills one sequence at a time with the item that fits and whose amounts, as shares of
the limits, have the largest dot product with what is left of them. Where no item fits whole and more than ``gap``
tokens are left, the best one is cut and its rest stays an item. Documents over the limit give full sequences first.
Items of equal amounts are one kind, and the heuristic looks at kinds: a window has few, however many items it has.

Each task packs the rows it reads: texts are not shuffled, a task holds about ``window`` tokens or ``items`` items at a
time, and what its last window leaves unfilled is one sequence a task. A task that is run again reads the same rows in
the same order and gives the same pieces; sequence numbers hold the task's number.

Ids are those of the tokenizer file for each whole text. The tokenizer folds ASCII letters and drops white space, so
that its ids for a text are those of the folded runs between spaces and line ends, one after another. The distinct runs
of a chunk of texts are looked up, those not seen before go to the tokenizer in batches, and the ids are gathered by
array. Added tokens are matched before folding, so that texts with one in any case go to the tokenizer whole.

Nulls and odd rows: a null or empty text has no ids but the end mark. A null doc_id stays null. Repeated rows, also of
one doc_id, are packed each; ties between items of equal amounts go to the later row. Very long texts are cut into full
sequences. Extra columns are ignored whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Bytes of text a task turns into ids at a time.
CHUNK = 1 << 24
#: Letters and digits that are a piece, or part of one, of their own to the tokenizer; a full stop or comma after one is too.
LATIN = r"a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"


def _listed(x: pa.Array) -> list:
    return x.to_numpy(zero_copy_only=False).tolist()


class Tokens:
    """Ids of whole texts, put together from those of their runs. A worker keeps what it knows between tasks, up to a bound."""

    known: dict[str, dict[str, bytes]] = {}

    def __init__(self, path: str, end: int | None, most: int = 1 << 20) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tail = b"" if end is None else np.array([end], "<u4").tobytes()
        self.cores = self.known.setdefault(path, {})
        self.most = most
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._encoded([m])[0] for m in ".,"}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat, stops = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), np.cumsum([4 * len(i) for i in ids]).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def _learn_words(self, words: list[str]) -> None:
        """Words of Latin letters are one piece each to the tokenizer, and the last id of a piece has the word-end mark."""
        for at in range(0, len(words), 1 << 14):
            some = words[at : at + (1 << 14)]
            joined = [" ".join(some[i : i + 256]) for i in range(0, len(some), 256)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some):
                flat = ids.tobytes()
                self.cores.update((c, flat[a:b]) for c, a, b in zip(some, [0, *stops], stops, strict=False))

    def _learn(self, cores: pa.Array) -> None:
        """Ids of runs; whatever the joined way can't part goes one by one."""
        if len(self.cores) > self.most:
            self.cores.clear()
        new = list(set(_listed(cores)).difference(self.cores))
        if self.ends.any() and new:
            self._learn_words(_listed(pa.array(new).filter(pc.match_substring_regex(pa.array(new), f"^[{LATIN}]+$"))))
        rest = [c for c in new if c not in self.cores]
        for at in range(0, len(rest), 1 << 14):
            some = rest[at : at + (1 << 14)]
            self.cores.update(zip(some, self._encoded(some), strict=True))

    def _runs(self, runs: pa.Array) -> list[bytes]:
        """Ids of folded runs. A full stop or comma at the end is a piece of its own, and so more runs share an entry."""
        marked = pc.match_substring_regex(runs, f"[0-9{LATIN}][.,]$")
        cores = pc.if_else(marked, pc.utf8_slice_codeunits(runs, 0, -1), runs)
        self._learn(cores)
        found = list(map(self.cores.__getitem__, _listed(cores)))
        for m, ids in self.marks.items():
            for i in np.flatnonzero(pc.and_(marked, pc.ends_with(runs, m)).to_numpy(zero_copy_only=False)).tolist():
                found[i] += ids
        return found

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the place where those of each begin, with the end of all."""
        texts = pc.fill_null(texts, "")
        folded = pc.ascii_lower(texts)
        raw = np.zeros(len(texts), bool)
        for t in self.added:
            raw |= pc.match_substring(folded, t).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(raw), "", folded), "\n", " "), " ")
        runs = cut.flatten().dictionary_encode()
        blobs = self._runs(runs.dictionary)
        codes, bounds = runs.indices.to_numpy(), cut.offsets.to_numpy()
        whole = np.flatnonzero(raw)  # a text that was put aside has one empty run
        codes = codes.copy()
        codes[bounds[whole]] = len(blobs) + np.arange(len(whole))
        blobs += self._encoded(_listed(texts.filter(pa.array(raw)))) if len(whole) else []
        codes, bounds = np.insert(codes, bounds[1:], len(blobs)), bounds + np.arange(len(bounds))
        blobs.append(self.tail)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        begins = np.cumsum(sizes) - sizes
        flat, long = np.frombuffer(b"".join(blobs), "<u4"), sizes[codes]
        stops = np.cumsum(long)
        ids = flat[np.repeat(begins[codes] - (stops - long), long) + np.arange(stops[-1])]
        return ids, np.concatenate([[0], stops])[bounds]


class Packer:
    """Sequences of one window. Items: tokens, one segment, loss-bearing tokens; a cut keeps loss in proportion."""

    def __init__(self, limits: tuple[int, int, int], gap: int) -> None:
        self.limits, self.gap = np.array(limits, np.int64), gap

    def _copies(self, best: int, share: np.ndarray, score: np.ndarray) -> int:
        """How many items of the best kind go in before another kind would score more."""
        faster = share[:, best] @ (share[:, best, None] - share)
        ahead = score[best] - score
        return 1 + int((ahead[faster > 0] / faster[faster > 0]).min(initial=1e9))

    def fill(self, tokens: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces as arrays: item, start in it, length, sequence. The last sequence may be far from full."""
        pairs, kind = np.unique(np.stack([tokens, np.ones_like(tokens), loss]).astype(np.int64), axis=1, return_inverse=True)  # a column a kind
        order = np.argsort(kind.ravel(), kind="stable")
        count = np.bincount(kind.ravel(), minlength=pairs.shape[1])
        waiting = [w.tolist() for w in np.split(order, np.cumsum(count)[:-1])]
        number = {tuple(p): k for k, p in enumerate(pairs.T.tolist())}
        start = np.zeros(len(tokens), np.int64)
        per = 1 / self.limits
        items: list[int] = []
        starts: list[int] = []
        lengths: list[int] = []
        ends: list[int] = []
        while len(live := np.flatnonzero(count)):
            room, at, amount = self.limits.copy(), live, pairs[:, live]
            while True:
                ok = np.flatnonzero((amount[0] <= room[0]) & (amount[1] <= room[1]) & (amount[2] <= room[2]) & (count[at] > 0))
                if not len(ok):
                    break
                at, amount = at[ok], amount[:, ok]
                score = (room * per * per) @ amount
                b = int(score.argmax())
                k, size = int(at[b]), amount[:, b]
                n = 1
                if count[k] > 1:
                    n = int(min(count[k], (room // np.maximum(size, 1))[size > 0].min()))
                    if n > 1 and len(at) > 1:
                        n = min(n, self._copies(b, amount * per[:, None], score))
                taken = waiting[k][-n:]
                del waiting[k][-n:]
                count[k] -= n
                room = room - n * size
                items += taken
                starts += start[taken].tolist()
                lengths += [int(size[0])] * n
            live = live[count[live] > 0]
            if room[0] > self.gap and room[1] > 0 and len(live):
                amount = pairs[:, live]
                part = np.minimum(np.where(amount[2] > 0, room[2] * amount[0] // np.maximum(amount[2], 1), room[0]), np.minimum(room[0], amount[0] - 1))
                n = int(part.max())
                if n > self.gap:
                    k = int(live[np.where(part == n, (room * per * per) @ amount, -1.0).argmax()])
                    size, i = pairs[:, k].tolist(), waiting[k].pop()
                    count[k] -= 1
                    items.append(i)
                    starts.append(int(start[i]))
                    lengths.append(n)
                    start[i] += n
                    rest = (size[0] - n, 1, size[2] - -(-size[2] * n // size[0]))
                    if rest not in number:
                        number[rest] = len(waiting)
                        waiting.append([])
                        pairs, count = np.column_stack([pairs, rest]), np.append(count, 0)
                    waiting[number[rest]].append(i)
                    count[number[rest]] += 1
            ends.append(len(items))
        sizes = np.diff([0, *ends])
        return np.array(items, np.int64), np.array(starts, np.int64), np.array(lengths, np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about CHUNK bytes of text, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class Window:
    """Items that wait to be packed, as arrays by item; ids holds those of all of them."""

    def __init__(self) -> None:
        self.ids = np.zeros(0, "<u4")
        self.item = pd.DataFrame({"doc": np.zeros(0, np.int64), "none": np.zeros(0, bool), "at": np.zeros(0, np.int64), "total": np.zeros(0, np.int64), "place": np.zeros(0, np.int64), "length": np.zeros(0, np.int64), "share": np.zeros(0)})

    def add(self, ids: np.ndarray, item: pd.DataFrame) -> None:
        self.item = pd.concat([self.item, item.assign(place=item["place"] + len(self.ids))], ignore_index=True)
        self.ids = np.concatenate([self.ids, ids])

    def pieces(self, item: np.ndarray, start: np.ndarray, length: np.ndarray, sequence: np.ndarray) -> pa.RecordBatch:
        of = self.item.take(item)
        raw, place = memoryview(np.ascontiguousarray(self.ids)).cast("B"), (of["place"].to_numpy() + start).tolist()
        crc = [zlib.crc32(raw[4 * p : 4 * (p + n)]) for p, n in zip(place, length.tolist(), strict=True)]
        before = np.cumsum(length) - length
        offset = before - before[np.searchsorted(sequence, sequence)] if len(sequence) else before
        return pa.RecordBatch.from_arrays([pa.array(of["doc"].to_numpy(), pa.int64(), mask=of["none"].to_numpy()), *[pa.array(x, pa.int64()) for x in (of["at"].to_numpy() + start, length, crc, of["total"].to_numpy(), sequence, offset)]], NAMES)

    def left(self, item: np.ndarray, start: np.ndarray, length: np.ndarray) -> Window:
        """The window of these pieces alone."""
        out, of = Window(), self.item.take(item)
        spans = [self.ids[p : p + n] for p, n in zip((of["place"].to_numpy() + start).tolist(), length.tolist(), strict=True)]
        out.add(np.concatenate(spans), of.assign(at=of["at"].to_numpy() + start, length=length, place=np.cumsum(length) - length))
        return out


def pack(docs: DataFrame, tokenizer_path: str, end: int | None = 2, limits: tuple[int, int, int] = (4096, 256, 4096), loss_share: Callable[[pd.DataFrame], np.ndarray] | None = None, gap: int = 16, window: int = 1 << 20, items: int = 1 << 18) -> DataFrame:
    """docs (doc_id, text) -> pieces. loss_share: of each row, without its text, the part of its tokens that bear loss (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, held = Tokens(tokenizer_path, end), Packer(limits, gap), Window()
        task, made = TaskContext.get().partitionId() << 40, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, made
            length = held.item["length"].to_numpy()
            item, start, n, sequence = packer.fill(length, np.ceil(length * held.item["share"].to_numpy()).astype(np.int64))
            done = len(item) if last or not sequence[-1] else int(np.searchsorted(sequence, sequence[-1]))
            out = held.pieces(item[:done], start[:done], n[:done], task + made + sequence[:done])
            made += int(sequence[done - 1]) + 1
            held = held.left(item[done:], start[done:], n[done:]) if done < len(item) else Window()
            return out

        for batch in chain.from_iterable(map(_chunks, batches)):
            doc = batch.column("doc_id")
            ids, bounds = tokens.of(batch.column("text"))
            share = np.ones(batch.num_rows) if loss_share is None else np.asarray(loss_share(batch.drop_columns(["text"]).to_pandas()), float)
            item = pd.DataFrame({"doc": pc.fill_null(doc, 0).to_numpy(), "none": pc.is_null(doc).to_numpy(zero_copy_only=False), "at": 0, "total": np.diff(bounds), "place": bounds[:-1], "length": np.diff(bounds), "share": share})
            full = np.minimum(limits[0], np.where(share > 0, np.maximum(limits[2] / np.maximum(share, 1e-9), 1), limits[0])).astype(np.int64)
            times = item["length"].to_numpy() // full
            here = Window()
            here.add(ids, item)
            long = np.repeat(np.flatnonzero(times), times[times > 0])
            if len(long):  # one sequence each
                nth = np.arange(len(long)) - np.searchsorted(long, long)
                yield here.pieces(long, nth * full[long], full[long], task + made + np.arange(len(long)))
                made += len(long)
            done = times * full
            rest = item.assign(at=done, place=item["place"] + done, length=item["length"] - done)
            held.add(ids, rest[rest["length"] > 0])
            if held.item["length"].sum() >= window or len(held.item) >= items:
                yield flush(False)
        if len(held.item):
            yield flush(True)

    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, OUT)
