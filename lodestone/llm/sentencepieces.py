"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring.

Three machines are compiled from a model: the normaliser (character map, dummy prefix, white-space marks), the pieces
with their byte fallback, and a machine of weights. Each input is composed with them, and the shortest path of the composition is the
encoding. For a unigram model the weights are the pieces' negative log-probabilities. For a BPE model they are on pairs:
the state is the last piece, and an arc from piece a to piece b weighs 0 if merging the string ab alone would give back
[a, b], and infinity if not. Merges that stay inside a and b happen in the same order with or without neighbours, so a
path has weight 0 exactly if it is what merging the whole input gives; every prefix has one such path, and one state
per position is enough. The arcs of a machine are made when first asked for and kept, as in a lazy composition."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
KEPT_SEGMENTS, KEPT_ARCS, KEPT_LENGTH = 400_000, 300_000, 48


class _Kept(dict):
    """Encodings of segments seen before; starts anew when full, so memory is bounded."""

    def __init__(self, find, prefix: str) -> None:
        super().__init__()
        self.find, self.prefix = find, prefix

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.find(self.prefix + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[word] = ids
        return ids


class CharacterMap:
    """The normaliser's rewriting transducer: a trie of byte strings, as models store it (an array of units, then the
    outputs), unrolled into states with arcs. The longest match at each place is replaced by its output, a character
    without one is kept."""

    def __init__(self, raw: bytes) -> None:
        size = int.from_bytes(raw[:4], "little")
        self.units, self.outputs = array("I", raw[4 : 4 + size]), raw[4 + size :]
        if sys.byteorder == "big":
            self.units.byteswap()
        self.states: dict[int, tuple[dict[int, int], bytes | None]] = {}

    def state(self, at: int) -> tuple[dict[int, int], bytes | None]:
        """Arcs (byte, next state) and output of the state at a unit; made when first asked for."""
        kept = self.states.get(at)
        if kept is None:
            unit = self.units[at]
            base = at ^ ((unit >> 10) << ((unit & 0x200) >> 6))
            arcs = {c: base ^ c for c in range(1, 256) if base ^ c < len(self.units) and self.units[base ^ c] & 0x800000FF == c}
            out = None
            if unit >> 8 & 1:
                start = self.units[base] & 0x7FFFFFFF
                out = self.outputs[start : self.outputs.index(b"\0", start)]
            kept = self.states[at] = arcs, out
        return kept

    def rewrite(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            state, end, best = 0, at, None
            while end < len(raw) and (state := self.state(state)[0].get(raw[end], -1)) >= 0:
                end += 1
                if self.state(state)[1] is not None:
                    best = end, self.state(state)[1]
            if best is None:
                end = at + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                best = end, raw[at:end]
            out.append(best[1])
            at = best[0]
        return b"".join(out).decode("utf-8", "replace")


class Transducers:
    """The compiled machines of one model; `encode` and `decode` take whole texts of any length."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with leading white-space marks are supported")
        self.characters = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.bpe = {1: False, 2: True}[proto.trainer_spec.model_type]
        self.prefix, self.squeeze, self.fallback = norm.add_dummy_prefix, norm.remove_extra_whitespaces, proto.trainer_spec.byte_fallback
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes, self.unknown, shown = [0] * 256, 0, []
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                shown.append(p.piece.replace(MARK, " "))
            elif p.type == BYTE:
                b = int(p.piece[3:5], 16)
                self.bytes[b] = i
                shown.append(chr(b) if b < 128 else chr(0xDC00 + b))
            elif p.type == UNKNOWN:
                self.unknown = i
                shown.append(" ⁇ ")
            elif p.type == CONTROL:
                shown.append("")
            else:
                raise ValueError("models with unused or user-defined pieces are not supported")
        self.shown = shown
        self.weights = {} if self.bpe else {p: np.float32(-x) for p, x in self.scores.items()}
        self.lowest = min(self.scores.values(), default=0.0) - 10.0
        self.trie: dict = {}
        for piece in self.ids:
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = piece
        joined = {ch for piece in self.ids if len(piece) > 1 for ch in piece}
        self.alone = lambda ch: ch not in joined
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.ids)  # no piece reaches from a word into the next
        self.by_lines = self.cut and "\n" not in joined
        self.newline = self.symbol("\n")
        self.arcs: dict[tuple[str, str], bool] = {}
        self.lasts: dict[str, list[tuple[str, float]]] = {}
        self.firsts: dict[str, list[tuple[str, float]]] = {}
        self.marked, self.plain = _Kept(self.segment, MARK), _Kept(self.segment, "")

    def symbol(self, piece: str) -> tuple[int, ...]:
        """Output labels of a piece, or of a character that is none: its bytes, or the unknown piece."""
        if piece in self.ids:
            return (self.ids[piece],)
        return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")) if self.fallback else (self.unknown,)

    def edges(self, piece: str, at: int) -> list[tuple[str, float]]:
        """How one end of a piece (at 0 its first, at -1 its last symbol) changes while it is merged on its own: the
        symbol there and the score of the merge that comes next, -inf at the end. Empty if it isn't merged into one."""
        parts, scores, out = list(piece), self.scores, []
        while True:
            best, where = -math.inf, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, where = score, i
            out.append((parts[at], best))
            if where < 0:
                return out if len(parts) == 1 else []
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def arc(self, a: str, b: str) -> bool:
        """Whether the arc from piece a to piece b has weight 0: the two are merged side by side, and no merge over
        their border ever comes first (of equal scores the one further left does)."""
        kept = self.arcs.get((a, b))
        if kept is not None:
            return kept
        left, right = self.lasts.get(a), self.firsts.get(b)
        if left is None:
            left = self.lasts[a] = self.edges(a, -1) if a else []
        if right is None:
            right = self.firsts[b] = self.edges(b, 0)
        kept, i, j, scores = bool(right) and (bool(left) or not a), 0, 0, self.scores
        while kept and a:
            (x, next_a), (y, next_b) = left[i], right[j]
            over = scores.get(x + y)
            if over is not None and over > next_a and over >= next_b:
                kept = False
            elif next_a >= next_b:
                if next_a == -math.inf:
                    break
                i += 1
            else:
                j += 1
        if len(self.arcs) >= KEPT_ARCS:
            self.arcs.clear()
        self.arcs[a, b] = kept
        return kept

    def path_bpe(self, s: str) -> list[str]:
        n, trie, arc, alone = len(s), self.trie, self.arc, self.alone
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        for at in range(n):
            before = last[at]
            if before is None:
                continue
            ch = s[at]
            if last[at + 1] is None and (alone(ch) or arc(before, ch)):
                last[at + 1] = ch
            if len(before) == 1 and alone(before):
                before = ""
            node, end = trie.get(ch), at + 1
            while node is not None and end < n:
                node = node.get(s[end])
                end += 1
                if node is not None and "" in node and last[end] is None and arc(before, node[""]):
                    last[end] = node[""]
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def path_unigram(self, s: str) -> list[str]:
        """The path of the least sum of weights, in single precision as the model format has it; of equal ones the first."""
        n, trie, weights, lowest = len(s), self.trie, self.weights, np.float32(-self.lowest)
        cost, last = [np.float32(0)] + [np.float32(math.inf)] * n, [""] * (n + 1)
        for at in range(n):
            node, end = trie, at
            while end < n:
                node = node.get(s[end])
                end += 1
                if node is None:
                    break
                if "" in node and (c := cost[at] + weights[node[""]]) < cost[end]:
                    cost[end], last[end] = c, node[""]
            if s[at] not in weights and (c := cost[at] + lowest) < cost[at + 1]:
                cost[at + 1], last[at + 1] = c, s[at]
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def segment(self, s: str) -> tuple[int, ...]:
        ids: list[int] = []
        unknown_before = False
        for piece in self.path_bpe(s) if self.bpe else self.path_unigram(s):
            known = piece in self.ids
            if known or self.fallback or not unknown_before:  # a run of unknown characters is one unknown piece
                ids.extend(self.symbol(piece))
            unknown_before = not known
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of a text; none for a null or empty one."""
        if self.characters and text:
            text = self.characters.rewrite(text)
        if self.squeeze and text:
            text = re.sub(" +", " ", text.replace(MARK, " ")).strip(" ")
        if not text:
            return []
        ids: list[int] = []
        for number, line in enumerate(text.split("\n")) if self.by_lines else [(0, text)]:
            if number:
                ids.extend(self.newline)
            prefixed = self.prefix and not number
            if not self.cut:
                ids.extend(self.segment((MARK if prefixed else "") + line.replace(" ", MARK)))
            elif "  " in line or MARK in line or prefixed and line[:1] == " ":
                for part in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", (MARK if prefixed else "") + line.replace(" ", MARK)):
                    ids.extend(self.plain[part])
            else:
                words = line.split(" ")
                if words[0] or prefixed:
                    ids.extend((self.marked if prefixed else self.plain)[words[0]])
                del words[0]
                ids.extend(chain.from_iterable(map(self.marked.__getitem__, words)))
        return ids

    def decode(self, ids) -> str:
        """The text of piece ids: marks become spaces, byte runs are read as UTF-8, the dummy prefix goes."""
        text = "".join(map(self.shown.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Model:
    """A model's bytes, to be broadcast; each worker compiles it when first asked, and lets go of it with the broadcast."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.made = raw, None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "made": None}

    @property
    def machine(self) -> Transducers:
        if self.made is None:
            self.made = Transducers(self.raw)
        return self.made


def _runner(model, with_ids: bool):
    import pyarrow as pa

    def run(batches):
        machine = model.value.machine
        for batch in sliced(batches):
            sizes, digests, texts, same, lists = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = array("i", machine.encode(text))
                back = machine.decode(ids)
                sizes.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                texts.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (text or ""))
                if with_ids:
                    lists.append(pa.array(memoryview(ids), pa.int32()) if ids else pa.array([], pa.int32()))
            cols = {"n_pieces": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(texts, pa.string()), "round_trip": pa.array(same, pa.bool_())}
            if with_ids:
                offsets = pa.array([0, *_running(sizes)], pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols.values()], names=["doc_id", *cols])

    return run


def _running(sizes):
    total = 0
    for n in sizes:
        total += n
        yield total


def encode_documents(documents: DataFrame, model_path: str = MODEL, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as 32-bit little-endian), decoded_sha256, round_trip of every row of
    `documents` (doc_id, text), and the ids themselves if `with_ids`.

    The model is read once, by the driver. Null and empty texts have no pieces and decode to the empty text. A null
    doc_id stays null; repeated rows give repeated rows; an empty table gives none; other columns are not read.
    round_trip is false only where the text has a white-space mark (U+2581), which the model format writes as a space."""
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(Model(f.read()))
    schema = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_runner(model, with_ids), schema)
