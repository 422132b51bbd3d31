"""Substring deduplication over bytes: suffixes of candidate stretches, ordered by deep-shallow sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.batches import LAST, Batch, Columns, answer, ask, pack_documents, visit
from dossier.llm.debruijn import KEY_ANSWER, KEY_FIELDS, U, key_question, key_reply, may_repeat
from dossier.llm.durable import stored

LENGTH = 50
#: Bytes of text for a part.
PART_BYTES = 6 << 20
#: Bytes of the substring whose least hash in a window names the window, and bytes that multikey sorting compares.
ANCHOR, SHALLOW = 24, 24


#: Fixed random odd numbers, one for each eight bytes of an anchor and one to mix; and places that are hashed at once.
_TIMES = np.random.default_rng(7).integers(1 << 62, 1 << 63, 32, dtype=np.uint64) | U(1)
STEP = 1 << 15


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as a view."""
    return np.ndarray((max(0, len(data) - 7),), np.uint64, data, strides=(1,))


def anchors(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For each window of ``length`` bytes the least hash of a substring of ``anchor`` bytes (at least 8) in it."""
    n, width, eights = len(data) - length + 1, length - anchor + 1, _eights(data)
    places = [*range(0, anchor - 8, 8), anchor - 8]
    out = np.empty(n, np.uint64)
    for s in range(0, n, STEP):
        e = min(n, s + STEP)
        m = e - s + width - 1
        w = eights[s : s + m + anchor - 8].copy()
        h = w[:m] * _TIMES[0]
        for t, p in zip(_TIMES[1:], places[1:], strict=False):
            h += w[p : p + m] * t
        h ^= h >> U(32)
        h *= _TIMES[-1]
        out[s:e] = _sliding_min(h, width)
    return out


class Stretches:
    """Maximal runs of windows of one text that have the same anchor, and which of them are equal in the batch.

    start: byte of the first window; windows: how many; row; anchor: hash. Equal windows have equal anchors wherever
    they stand.
    """

    def __init__(self, batch: Batch, length: int, anchor: int):
        self.batch, self.length = batch, length
        n = len(batch.data) - length + 1
        if n <= 0:
            self.start = self.windows = self.row = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
        else:
            name = anchors(batch.data, length, anchor)
            change = np.empty(n, bool)
            change[0] = True
            np.not_equal(name[1:], name[:-1], out=change[1:])
            # A row's windows begin at its start; those from its last ``length - 1`` bytes on would leave it.
            edges = np.concatenate([batch.starts[:-1], np.maximum(batch.starts[1:] - length + 1, 0)])
            change[edges[edges < n]] = True
            cuts = np.nonzero(change)[0]
            windows = np.diff(np.append(cuts, n))
            row = np.searchsorted(batch.starts, cuts, side="right") - 1
            keep = batch.starts[row + 1] - cuts >= length
            self.start, self.windows, self.row = cuts[keep], windows[keep], row[keep]
            self.anchor = name[self.start]
        self.ids = batch.ids[self.row]

    def kinds(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches ``some``: the number of each one's content (anchors first, then digests), the first with
        the least id of each content, and the 128-bit digests of the contents as two columns."""
        data, ends = self.batch.data.tobytes(), self.start[some] + self.windows[some] + self.length - 1
        digests = b"".join([xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(self.start[some].tolist(), ends.tolist(), strict=True)])
        digest = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        key = self.anchor[some] >> U(32)
        order = np.lexsort((np.arange(len(some)), self.ids[some], digest[:, 1], digest[:, 0], key))
        new = _changes(key[order], digest[order, 0], digest[order, 1])
        kind = np.zeros(len(some), np.int64)
        kind[order] = np.cumsum(new) - 1
        return kind, order[new], digest[order[new]]


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where an entry differs from the one before it in any column."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


# The digests of what may repeat, and what a part says of them: GONE if a smaller id has the whole stretch, SHOW if others
# with the same anchor differ, so that bytes must be compared.
DIGEST_FIELDS = {"part": np.uint32, "key": np.uint32, "one": np.uint64, "two": np.uint64, "id": np.int64}
DIGEST_ANSWER = {"digest_part": np.uint32, "digest_entry": np.uint32, "state": np.uint8}
GONE, SHOW = 1, 2


def digest_reply(batch: np.ndarray, asked: Columns) -> tuple[np.ndarray, Columns]:
    """Equal stretches are one. Of each, the rows with the least id show their bytes if the anchor has other stretches;
    32 bits of an anchor may join two anchors, which costs a needless look and nothing else."""
    order = np.lexsort((asked["id"], asked["two"], asked["one"], asked["key"]))
    key, ids = asked["key"][order], asked["id"][order]
    unit = _changes(key, asked["one"][order], asked["two"][order])
    head = np.nonzero(_changes(key))[0]
    least = ids[unit][np.cumsum(unit) - 1] if len(ids) else ids
    several = np.repeat(np.add.reduceat(unit.astype(np.int64), head) > 1, np.diff(np.r_[head, len(key)])) if len(key) else unit
    state = np.where(ids > least, GONE, np.where(several, SHOW, 0)).astype(np.uint8)
    told = order[state > 0]
    return batch[told], {"digest_part": asked["part"][told], "digest_entry": asked["entry"][told], "state": state[state > 0]}


PIECE_FIELDS = {"part": np.uint32, "anchor": np.uint64, "id": np.int64, "windows": np.uint32}
PIECE_ANSWER = {"piece_part": np.uint32, "piece_entry": np.uint32, "from": np.uint32, "to": np.uint32}


class BlindTrie:
    """Orders strings of one length: inner nodes know only where their branches differ, leaves hold equal strings."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def insert(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = (string, [member])
            return
        node = self.root
        while isinstance(node, list):  # [place, {byte: child}]; go down blindly
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == string:
            node[1].append(member)
            return
        differ = int.from_bytes(string) ^ int.from_bytes(other)
        place = self.size - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < place:
            parent, node = node, node[1][string[node[0]]]
        if isinstance(node, list) and node[0] == place:
            node[1][string[place]] = (string, [member])
            return
        branch = [place, {string[place]: (string, [member]), other[place]: node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][string[parent[0]]] = branch

    def groups(self) -> list[list[int]]:
        """Members by string, in order."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                found.append(node[1])
        return found


def _words(eights: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Big-endian numbers of ``size`` bytes at each place."""
    return eights[at].byteswap() >> U(8 * (8 - size))


def equal_suffixes(data: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """A number for each place, the same where the ``length`` bytes from it are the same, -1 where no other are.

    Deep-shallow sorting: multikey passes of 8 bytes order the suffixes to the shallow depth, and a group of one is
    done. Groups that share the prefix go on: one whose members all agree to the end needs no order, and a blind trie
    orders each of the others.
    """
    label, eights = np.full(len(at), -1, np.int64), _eights(np.concatenate([data, np.zeros(8, np.uint8)]))
    members, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, shallow, 8):
        key = _words(eights, at[members] + depth, 8)
        order = np.lexsort((key, group))
        members, group, key = members[order], group[order], key[order]
        if not len(members):
            return label
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        starts = np.nonzero(new)[0]
        size = np.diff(np.r_[starts, len(members)])
        many = np.repeat(size > 1, size)
        members, group = members[many], (np.cumsum(new) - 1)[many]
    if not len(members):
        return label
    starts = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
    ends = np.r_[starts[1:], len(members)]
    head = np.repeat(members[starts], ends - starts)
    agree = np.ones(len(members), bool)
    for depth in range(shallow, length, 8):
        step = min(8, length - depth)
        agree &= _words(eights, at[members] + depth, step) == _words(eights, at[head] + depth, step)
    same = np.minimum.reduceat(agree.astype(np.int8), starts) > 0
    plain = np.repeat(same, ends - starts)
    label[members[plain]] = np.cumsum(np.r_[True, group[1:] != group[:-1]])[plain]
    top, tail = len(starts) + 1, length - shallow
    for s, e in zip(starts[~same].tolist(), ends[~same].tolist(), strict=True):
        trie = BlindTrie(tail)
        for m in members[s:e].tolist():
            trie.insert(data[at[m] + shallow : at[m] + length].tobytes(), m)
        for found in trie.groups():
            label[found] = top
            top += 1
    return label


def _piece_reply(length: int):
    """Ranges of each shown stretch's windows that a smaller id has too. All windows whose anchors meet are sorted."""

    def reply(batch: np.ndarray, asked: Columns, text: np.ndarray) -> tuple[np.ndarray, Columns]:
        ids, windows = asked["id"], asked["windows"].astype(np.int64)
        if not len(ids):
            return batch, {"piece_part": asked["part"], "piece_entry": asked["entry"], "from": asked["part"], "to": asked["part"]}
        size, total = windows + length - 1, np.cumsum(windows)
        inner = np.arange(total[-1]) - np.repeat(total - windows, windows)
        label = equal_suffixes(text, np.repeat(np.cumsum(size) - size, windows) + inner, length)
        own = np.repeat(ids, windows)
        lowest = np.full(label.max() + 2, LAST, np.int64)
        np.minimum.at(lowest, label, own)
        gone = (label >= 0) & (lowest[label] < own)
        edge = np.diff(np.r_[0, gone.astype(np.int8)])
        starts = np.nonzero((edge == 1) | (gone & (inner == 0)))[0]
        stops = np.nonzero(gone & np.r_[~gone[1:] | (inner[1:] == 0), True])[0]
        entry = np.searchsorted(total, starts, side="right")
        found = {"from": inner[starts].astype(np.uint32), "to": (inner[stops] + 1).astype(np.uint32)}
        return batch[entry], {"piece_part": asked["part"][entry], "piece_entry": asked["entry"][entry]} | found

    return reply


def _entries(parts: np.ndarray) -> np.ndarray:
    """The place of each among those of its part, as ``ask`` deals them."""
    order = np.argsort(parts, kind="stable")
    first = np.nonzero(_changes(parts[order]))[0]
    entry = np.zeros(len(parts), np.int64)
    entry[order] = np.arange(len(parts)) - np.repeat(first, np.diff(np.r_[first, len(parts)]))
    return entry


def _find(part: np.ndarray, entry: np.ndarray, wanted_part: np.ndarray, wanted_entry: np.ndarray) -> np.ndarray:
    """Where each wanted (part, entry) is."""
    code, wanted = (p.astype(np.int64) << 32 | e.astype(np.int64) for p, e in ((part, entry), (wanted_part, wanted_entry)))
    order = np.argsort(code)
    return order[np.searchsorted(code[order], wanted)] if len(code) else np.zeros(0, np.int64)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def without_repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Rows of RESULT: each text without the bytes that a string of ``length`` bytes, repeated from a smaller doc_id, covers.

    Candidate windows meet in the part of their anchor, so equal strings always meet: whole stretches of windows are
    told to be equal by 128-bit digests, and where stretches with one anchor differ, their bytes are sorted. Null texts
    are empty; shorter texts repeat nothing. Repeated rows of an id do not repeat each other; a null id is larger than
    all others, and so is the largest long, which counts as null. What is kept may cut a character in two, hence bytes.
    An empty table gives no rows.
    """
    packed = pack_documents(docs, doc_id=doc_id, text=text, part_bytes=PART_BYTES)
    parts = packed.parts

    def keys(batch: Batch, _: Columns):
        found = Stretches(batch, length, anchor)
        return key_question(found.anchor, found.ids, parts, inside=True)

    candidates = stored(answer(packed, ask(packed, None, {}, keys, KEY_FIELDS), KEY_FIELDS, key_reply, KEY_ANSWER))

    def numbered(batch: Batch, known: Columns):
        """What may repeat, its kinds, and where each kind stands in the question of digests."""
        found = Stretches(batch, length, anchor)
        some = np.nonzero(may_repeat(found.anchor, parts, known))[0]
        kind, first, digest = found.kinds(some)
        part = (found.anchor[some[first]] % U(parts)).astype(np.int64)
        return found, some, kind, first, digest, part, _entries(part)

    def digests(batch: Batch, known: Columns):
        found, some, _, first, digest, part, _ = numbered(batch, known)
        one = some[first]
        return part, {"part": part.astype(np.uint32), "key": (found.anchor[one] >> U(32)).astype(np.uint32), "one": digest[:, 0], "two": digest[:, 1], "id": found.ids[one]}

    told = stored(answer(packed, ask(packed, candidates, KEY_ANSWER, digests, DIGEST_FIELDS), DIGEST_FIELDS, digest_reply, DIGEST_ANSWER))
    # The candidates are needed again to number the stretches alike.
    known_fields = KEY_ANSWER | DIGEST_ANSWER
    known_rows = candidates.unionByName(told, allowMissingColumns=True)

    def shown(known: Columns, part: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kinds that show their bytes, and where each of them stands in the question of pieces."""
        show = known["state"] == SHOW
        kinds = np.sort(_find(part, entry, known["digest_part"][show], known["digest_entry"][show]))
        return kinds, _entries(part[kinds])

    def pieces(batch: Batch, known: Columns):
        found, some, _, first, _, part, entry = numbered(batch, known)
        kinds, _ = shown(known, part, entry)
        one = some[first[kinds]]
        columns = {"part": part[kinds].astype(np.uint32), "anchor": found.anchor[one], "id": found.ids[one], "windows": found.windows[one].astype(np.uint32)}
        return part[kinds], columns, (batch.data, found.start[one], found.windows[one] + length - 1)

    asked = ask(packed, known_rows, known_fields, pieces, PIECE_FIELDS, bytes_column="text")
    replies = answer(packed, asked, PIECE_FIELDS, _piece_reply(length), PIECE_ANSWER, bytes_column="text")

    def apply(batch: Batch, known: Columns) -> pa.Table:
        found, some, kind, first, _, part, entry = numbered(batch, known)
        change = np.zeros(len(batch.data) + 1, np.int64)
        if len(some):
            whole = np.zeros(len(first), bool)  # kinds that a smaller id has elsewhere
            gone = known["state"] == GONE
            whole[_find(part, entry, known["digest_part"][gone], known["digest_entry"][gone])] = True
            later = whole[kind] | (found.ids[some] > found.ids[some[first]][kind])
            np.add.at(change, found.start[some[later]], 1)
            np.add.at(change, found.start[some[later]] + found.windows[some[later]] + length - 1, -1)
            kinds, place = shown(known, part, entry)
            of = kinds[_find(part[kinds], place, known["piece_part"], known["piece_entry"])] if len(kinds) else np.zeros(0, np.int64)
            order = np.argsort(kind[~later], kind="stable")
            own, own_kind = some[~later][order], kind[~later][order]  # those of the least id, by kind
            lo, hi = np.searchsorted(own_kind, of), np.searchsorted(own_kind, of, side="right")
            to = np.repeat(np.arange(len(lo)), hi - lo)
            which = own[np.arange(len(to)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[to]] if len(to) else own[:0]
            np.add.at(change, found.start[which] + known["from"][to], 1)
            np.add.at(change, found.start[which] + known["to"][to] + length - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for r in range(batch.rows):
            a, b = batch.starts[r], batch.starts[r + 1]
            cut = gone[a:b]
            kept = batch.data[a:b][~cut].tobytes()
            spans = int((cut & ~np.r_[False, cut[:-1]]).sum()) if len(cut) else 0
            doc = int(batch.ids[r])
            out.append((None if doc == LAST else doc, int(b - a), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return visit(packed, known_rows.unionByName(replies, allowMissingColumns=True), known_fields | PIECE_ANSWER, apply, RESULT)


def op7_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
