"""SentencePiece BPE by a table of last tokens.

For a merge-type (BPE) model every prefix of a text has one last token: the
encoding of the prefix without it is the prefix's own encoding. So the encoder walks
over the text once, takes for each position the vocabulary pieces that end there from an
Aho-Corasick automaton, and stores the one that is compatible with the last token
of the prefix before it; the ids are then recovered backwards from the end.

Two tokens are compatible if the merge rules, applied to their concatenation, give
just these two back. That is decided by undoing the merges of both sides, latest
first: a merge across the boundary that would come earlier than the next inner
one breaks the pair.

Texts are cut where no merge can reach across (before a run of blanks, around a line
break), and a cut's ids are computed once per worker. The model is bounded by its
vocabulary; rows are independent, so the work stays in the scan's tasks: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import lean, ship, text_of

BLANK = "▁"
#: Cuts whose ids a worker keeps, pairs whose compatibility it keeps, longest cut that is kept.
CACHE, PAIRS, KEPT_CHARS = 1_000_000, 1_000_000, 64
#: Rows whose results a task holds at once.
SLICE = 64

_UNKNOWN = 1 << 20  # characters outside the vocabulary stand as _UNKNOWN + their code point


def merge_all(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces of ``text`` by merging, best score first, leftmost first; and the last merge made."""
    parts, last = list(text), None
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


class _Cuts(dict):
    """Ids of ``lead + cut``, computed at the first use of a cut; bounded."""

    def __init__(self, encode: Callable[[str], list[int]], lead: str):
        super().__init__()
        self._encode, self._lead = encode, lead

    def __missing__(self, cut: str) -> bytes:
        ids = np.array(self._encode(self._lead + cut), "<u2").tobytes()
        if len(cut) <= KEPT_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[cut] = ids
        return ids


class PrefixTable:
    """Encoder and decoder of one serialized SentencePiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and blanks before words is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a model that leaves texts as they are is needed")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self._prefix = BLANK if spec.add_dummy_prefix else ""
        self._bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bos, self.eos = self.processor.bos_id(), self.processor.eos_id()
        self._score = {piece: score for _, piece, score in normal}
        self._piece = {i: piece for i, piece, _ in normal}
        self._id = {piece: i for i, piece, _ in normal}
        joined = {c for piece in self._id if len(piece) > 1 for c in piece}
        if not joined <= set(self._id):
            raise ValueError("a character of a longer piece is no piece")
        if any(BLANK in p.lstrip(BLANK) for p in self._id):
            raise ValueError("a piece has a blank inside")
        # time of a token: when its last merge is made (single characters are there from the start)
        order = sorted({-s for p, s in self._score.items() if len(p) > 1})
        when = {s: t for t, s in enumerate(order)}
        self._time: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._direct: set[int] = set()  # tokens whose merges tie: pairs with them are merged outright
        self._automaton = ahocorasick.Automaton()
        for i, piece, score in normal:
            if len(piece) == 1:
                self._time[i] = -1
            else:
                parts, last = merge_all(piece, self._score)
                if len(parts) > 1:
                    continue  # never made by the merge rules
                self._time[i] = when[-score]
                self._halves[i] = (self._id[last[0]], self._id[last[1]])
            self._automaton.add_word(piece, (i, len(piece)))
        self._automaton.make_automaton()
        for i, (a, b) in self._halves.items():
            if BLANK * 2 in self._piece[i] or max(self._time[a], self._time[b]) >= self._time[i]:
                self._direct.add(i)
        alone = "" if "\n" in joined else "\n"
        self._cut = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + ("|\n" if alone else ""))
        self._single_breaks = bool(alone)
        self._words, self._plain = _Cuts(self._chunk, BLANK), _Cuts(self._chunk, "")
        self._pairs: dict[int, bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        if a >= _UNKNOWN:
            return True
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._merge_keeps(a, b)
        return known

    def _merge_keeps(self, a: int, b: int) -> bool:
        piece, time = self._piece, self._time
        if a in self._direct or b in self._direct or piece[a][-1] == piece[b][0] == BLANK:
            return merge_all(piece[a] + piece[b], self._score)[0] == [piece[a], piece[b]]
        limit = 1 << 30
        while True:
            joined = self._id.get(piece[a] + piece[b])
            if joined is not None and self._when(joined) < limit:
                return False
            if time[a] < 0 and time[b] < 0:
                return True
            if time[a] > time[b]:
                limit, a = time[a], self._halves[a][1]  # a's own merge is further left: it goes first
            else:
                limit, b = time[b] + 1, self._halves[b][0]

    def _when(self, i: int) -> int:
        t = self._time.get(i)
        if t is None:  # a piece that no text yields as a whole still takes part in merges
            order = sorted({-s for p, s in self._score.items() if len(p) > 1})
            t = self._time[i] = order.index(-self._score[self._piece[i]])
        return t

    def _chunk(self, text: str) -> list[int]:
        """Ids of one cut: the last token of every prefix, then backwards."""
        last = [-1] * (len(text) + 1)
        compatible = self._compatible
        for end, (token, length) in self._automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    before = last[start] = _UNKNOWN + ord(text[start - 1])
                if before < _UNKNOWN and not compatible(before, token):
                    continue
            last[end] = token
        ids, at = [], len(text)
        while at:
            token = last[at]
            if 0 <= token < _UNKNOWN:
                ids.append(token)
                at -= len(self._piece[token])
            else:
                ids.extend(self._bytes[b] for b in reversed(text[at - 1].encode("utf-8")))
                at -= 1
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """All ids with begin and end ids; an empty text is these two alone."""
        if not text:
            parts = []
        elif self._prefix and self._single_breaks and "  " not in text and text[0] != " " and BLANK not in text:
            # the usual case: every blank starts a cut, so the words are the cuts
            words, parts = self._words.__getitem__, []
            for at, line in enumerate(text.split("\n")):
                if at:
                    head, *rest = line.split(" ")
                    parts += (self._plain["\n"], self._plain[head])
                    parts.extend(map(words, rest))
                else:
                    parts.extend(map(words, line.split(" ")))
        else:
            parts = map(self._plain.__getitem__, self._cut.findall((self._prefix + text).replace(" ", BLANK)))
        inner = np.frombuffer(b"".join(parts), "<u2")
        return np.concatenate([[self.bos], inner, [self.eos]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


_LOADED: dict[str, PrefixTable] = {}


def _table(model: bytes) -> PrefixTable:
    """The table of this Python worker; workers serve many tasks."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PrefixTable(model)
    return _LOADED[key]


def piece_ids(docs: DataFrame, model_path: str, keep_ids: bool = False, keep_decoded: bool | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids, and
    decoded unless ``keep_decoded`` is False. A task holds the results of ``SLICE`` rows at once.

    The whole text is encoded with begin and end ids; null counts as empty, an empty text
    has just these two. Repeated rows give repeated results, other columns are ignored,
    an empty table gives no rows. The model file is read on the driver and sent once
    (its size is bounded by the vocabulary).
    """
    keep_decoded = keep_ids if keep_decoded is None else keep_decoded
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.value)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            kept: dict[str, list] = {"ids": [], "decoded": []}
            for text in batch.column("text"):
                ids = table.encode(text.as_py())
                decoded = table.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_ids:
                    kept["ids"].append(ids)
                if keep_decoded:
                    kept["decoded"].append(decoded)
            columns = [batch.column("doc_id"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names = ["doc_id", *out]
            if keep_ids:
                columns.append(pa.array(kept["ids"], pa.list_(pa.int32())))
                names.append("ids")
            if keep_decoded:
                columns.append(pa.array(kept["decoded"], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(lean(run), schema + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_decoded else ""))
