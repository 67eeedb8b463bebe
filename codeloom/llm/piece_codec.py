"""Operator 1: SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks over a text once. Each position keeps one backpointer, to the start of the best last piece. Only positions
whose following characters begin a piece that is longer still can start a later one: these survive, and none is further
back than the longest piece. Whenever the paths of all surviving positions pass one boundary, the ids before it are
final and are put out, so the search holds a window and never a text.

What lies between two boundaries found so depends on nothing else, so it is remembered, in a memo of bounded size: a span that
was met before is skipped, a new one is read with the space mark after it until the surviving paths converge. A span that
begins like the one before it goes on from the columns that are still in the window.

Path scores. In a unigram model a path adds its pieces' log probabilities. In a BPE model the scores are merge ranks, and
their sum does not order segmentations as the library does; there a path may only be extended by a piece that is
compatible with its last piece: merging the two pieces' characters by rank must give just these two. Exactly one path
reaches each position that way, and it is the library's result (the tests compare the two).
"""

from __future__ import annotations

import re
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import read_table, with_outputs

SPACE = "▁"
RUNS = re.compile(rf"{SPACE}+[^{SPACE}]*").findall
#: Spans that a worker remembers, and characters of one of them at most; both only bound the memo's size.
MEMO, MEMO_CHARS = 500_000, 48
PAIRS = 2_000_000
#: Characters of one batch, unless a single text is longer.
BATCH_CHARS = 4_000_000
#: What an unknown id decodes to; fixed by the model files.
UNKNOWN_TEXT = " \u2047 "
#: Subtracted from the least score of a unigram model for a character outside the vocabulary; the library's value.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces of a model: ids and scores of normal pieces, ids of byte pieces, and the texts of all ids."""

    def __init__(self, proto: bytes, bpe: bool = True):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self._set({sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}, [i for i in range(n) if sp.is_byte(i)], sp.unk_id(), bpe)

    @classmethod
    def of(cls, pieces: dict[str, float], bpe: bool) -> Vocabulary:
        """A vocabulary of given pieces and scores: id 0 is unknown, 1 to 256 are bytes, pieces follow in order."""
        self = cls.__new__(cls)
        self._set({p: (i, s) for i, (p, s) in enumerate(pieces.items(), 257)}, list(range(1, 257)), 0, bpe)
        return self

    def _set(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, bpe: bool) -> None:
        self.pieces, self.byte_ids, self.unknown, self.bpe = pieces, byte_ids, unknown, bpe
        self.longest = max(map(len, pieces), default=1)
        #: What a string is: bit 0 a proper end of a piece, bit 1 a piece.
        self.kind = dict.fromkeys((p[k:] for p in pieces for k in range(1, len(p))), 1)
        for p in pieces:
            self.kind[p] = self.kind.get(p, 0) | 2
        #: Strings with which a longer piece begins.
        self.opens = {p[:k] for p in pieces for k in range(1, len(p))}
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.id = {p: i for p, (i, _) in pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        # The bytes that each id stands for; control ids stand for none.
        known = {i: p.encode() for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.byte_of.items()} | {unknown: UNKNOWN_TEXT.encode()}
        each = [known.get(i, b"") for i in range(max(known) + 1)]
        self.sizes = np.array([len(b) for b in each], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(each), np.uint8)
        self.least = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        #: Pieces hold this mark only at their start (or hold nothing else), so a text can be cut before it.
        self.cuts = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        self.line_feed = any("\n" in p for p in pieces)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Characters of a short string after all merges, lowest rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        own = self.pairs.setdefault(left, {})
        found = own.get(right)
        if found is None:
            if self.n_pairs > PAIRS:
                self.pairs, self.n_pairs = {}, 0
            found = own[right] = self.merged(left + right) == ([left, right] if left else [right])
            self.n_pairs += 1
        return found

    def ids(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is not None:
            return [found[0]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]


class Lattice:
    """Best paths to every position of the characters read so far: the last piece of each, and where it starts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.chars, self.back, self.last, self.score = "", [0], [""], [0.0]

    def extend(self, text: str) -> None:
        """Reads more characters. A position asks the starts before it, nearest first, until no piece ends that far back."""
        v, last, back, score = self.v, self.last, self.back, self.score
        kind, longest, bpe, none, pairs, fits_of = v.kind.get, v.longest, v.bpe, {}, v.pairs.get, v.compatible
        self.chars = chars = self.chars + text
        for j in range(len(last), len(chars) + 1):
            best, start = 0.0, -1
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                piece = chars[i:j]
                what = kind(piece, 0)
                if what > 1 or i == j - 1:
                    if bpe:
                        # One path reaches each position: the only piece that ends there needs no test.
                        if start >= 0:
                            fits = pairs(last[start], none).get(chosen)
                            if fits_of(last[start], chosen) if fits is None else fits:
                                break
                        start, chosen = i, piece
                    else:
                        s = score[i] + (v.pieces[piece][1] if what > 1 else v.least)
                        if start < 0 or s >= best:
                            best, start, chosen = s, i, piece
                if not what & 1:
                    break
            last.append(chosen)
            back.append(start)
            score.append(best)

    def rewind(self, n: int) -> None:
        """Forgets all but the first n characters; what was found for them holds for any text that begins so."""
        self.chars = self.chars[:n]
        del self.back[n + 1 :], self.last[n + 1 :], self.score[n + 1 :]

    def ids(self, upto: int) -> list[int]:
        """Ids of the best path to a position."""
        out, known, last, back = [], self.v.id.get, self.last, self.back
        while upto:
            found = known(last[upto])
            if found is None:
                out += reversed(self.v.ids(last[upto]))
            else:
                out.append(found)
            upto = back[upto]
        out.reverse()
        return out


class StreamEncoder(Lattice):
    """Encodes characters as they come; push() and end() return the ids that have become final.

    A position survives while the characters from it on begin a longer piece, as only there, or at the end, can a later piece
    start. Where the paths of all that survive pass one boundary, the ids before it are put out. That is looked for after
    every space mark and every `look` characters, wherever the boundary then turns out to be.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.look = max(32, 2 * vocabulary.longest)
        self.whole = True  # nothing of the span was put out yet
        #: Boundaries at which surviving paths converged; the ends of texts are not among them.
        self.commits = 0

    def boundary(self) -> int:
        """The last boundary that the paths of all surviving positions pass."""
        chars, opens, back, n = self.chars, self.v.opens, self.back, len(self.chars)
        first = max(0, n - self.v.longest + 1)
        if self.v.cuts and chars[-1:] == SPACE:  # what begins a piece and ends in a mark then holds marks alone
            first = max(first, len(chars.rstrip(SPACE)))
        live = [i for i in range(first, n) if chars[i:] in opens]
        at = n
        while live:  # the highest path steps back until it meets the next
            while at > live[-1]:
                at = back[at]
            if at < live[-1]:
                insort(live, at)
                at = live.pop()
            while live and live[-1] == at:
                live.pop()
        return at

    def push(self, text: str) -> list[int]:
        out, at = [], 0
        while at < len(text):
            stop = (text.find(SPACE, at, at + self.look) + 1) or min(at + self.look, len(text))
            self.extend(text[at:stop])
            at, out = stop, out + self._commit()
        return out

    def _commit(self) -> list[int]:
        at = self.boundary()
        ids = self.ids(at)
        if at:  # the piece before the boundary stays known, as the next one must fit it
            self.commits += 1
            self.whole = False
            base = self.score[at]
            self.chars, self.last = self.chars[at:], self.last[at:]
            self.back, self.score = [max(0, b - at) for b in self.back[at:]], [s - base for s in self.score[at:]]
        return ids

    def end(self) -> list[int]:
        """The rest of a text, at whose end only one path is left."""
        return self.ids(len(self.chars))

    def span(self, text: str, follow: str) -> list[int]:
        """Ids of what stands between two marks: it is read with the character that follows, and all surviving paths must pass
        the boundary before that. Columns of the span before that hold for this one as well are kept."""
        n = 0
        if self.whole:
            for x, y in zip(text, self.chars):
                if x != y:
                    break
                n += 1
        if n:
            self.rewind(n)
        else:
            self.clear()
        self.whole, out = True, []
        if len(text) > self.look:
            out = self.push(text[n:])
            n = len(text)
        self.extend(text[n:] + follow)
        last, at = len(self.chars) - 1, self.boundary()
        if last not in (at, self.back[at]):
            raise ValueError(f"paths do not converge before {follow!r}")
        self.commits += 1
        return out + self.ids(last)


class Codec:
    """Encodes and decodes whole texts, span by span. New spans of a batch are searched in order, so that each goes on
    from the beginning that it shares with the one before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.stream = StreamEncoder(vocabulary)
        self.memo: dict[str, bytes] = {}  # by word after a space, "\n" and word after a line feed, run of spaces with word
        self.feed = np.array(vocabulary.ids("\n"), np.int32).tobytes()

    def _keys(self, text: str) -> list[str]:
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:  # no space before the first word of a further line
                out.append("\n" + words[0])
                del words[0]
            if "" in words:  # runs of spaces may form pieces of their own
                words = RUNS(SPACE + SPACE.join(words))
            out += words
        return out

    def _learn(self, spans: set[str]) -> dict[str, bytes]:
        """Ids of new spans by key."""
        made = {}
        for text, key in sorted((k[1:] if k[0] == "\n" else k if k[0] == SPACE else SPACE + k, k) for k in spans):
            # No piece holds a line feed, so nothing goes on over one; it stands for the end of a run of spaces.
            ids = array("i", self.stream.span(text, "\n" if text[-1:] == SPACE else SPACE)).tobytes()
            made[key] = self.feed + ids if key[0] == "\n" else ids
        return made

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """int32 ids of texts; none for an empty one. A space is put before a text, as the model's files ask for."""
        if len(self.memo) > MEMO:
            self.memo = {}
        plain = self.v.cuts and not self.v.line_feed
        keys = [self._keys(t) if t and plain and SPACE not in t else None for t in texts]
        get = self.memo.get
        parts = [list(map(get, own)) if own else None for own in keys]
        new = {w for own, part in zip(keys, parts) if part and None in part for w, p in zip(own, part) if p is None}
        made = self._learn(new) if new else {}
        self.memo.update((k, i) for k, i in made.items() if len(k) <= MEMO_CHARS)
        out = []
        for t, own, part in zip(texts, keys, parts):
            if part:
                out.append(b"".join([made[w] if p is None else p for w, p in zip(own, part)] if None in part else part))
            else:
                out.append(self._whole(t) if t else b"")
        return out

    def _whole(self, text: str) -> bytes:
        self.stream.clear()
        ids = self.stream.push(SPACE + text.replace(" ", SPACE))
        ids += self.stream.end()
        self.stream.clear()
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of runs of ids: the pieces' bytes one after another, without the space put first."""
        v = self.v
        ids = np.where((ids >= 0) & (ids < len(v.sizes)), ids, v.unknown)
        size = v.sizes[ids]
        stop = np.r_[0, np.cumsum(size)]
        raw = v.blob[np.repeat(v.starts[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        cuts = stop[np.r_[0, ends]].tolist()
        texts = [raw[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(cuts[:-1], cuts[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0]


def encode_texts(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of each whole text, and if asked for the text decoded from them.

    Null and empty texts have no ids and decode to an empty text. Decoding gives the text back exactly, but for U+2581,
    which the model reads as a space. All rows stay, and all columns but those with the name of an output, which give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file, of fixed size
    at = docs.columns.index(text_col)
    kept, out = with_outputs(docs, f"`{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for big in batches:
            codec = codec or Codec(Vocabulary(shared.value))
            sizes = np.cumsum([len(t or "") for t in big.column(at).to_pylist()])
            begin = 0
            while begin < big.num_rows:
                done = sizes[begin - 1] if begin else 0
                b = big.slice(begin, max(1, int(np.searchsorted(sizes, done + BATCH_CHARS, "right")) - begin))
                begin += b.num_rows
                parts = codec.encode_many(b.column(at).to_pylist())
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
                flat = np.frombuffer(b"".join(parts), np.int32)
                cols = [*(b.column(i) for i in kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded_col:
                    cols.append(pa.array(codec.decode_many(flat, ends[1:]), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, out.names)

    return docs.mapInArrow(run, out)


def decode_ids(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of their ids, in place of a column of that name; null ids give an empty text, unknown ids the
    library's mark for them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(ids_col)
    kept, out = with_outputs(rows, f"`{text_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(shared.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array([codec.decode(i or []) for i in b.column(at).to_pylist()], pa.string())], out.names)

    return rows.mapInArrow(run, out)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gave the text back."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = encode_texts(rows, model_bytes(path), decoded_col="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))).alias("round_trip"))


def op1_piece_codec(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"), model)
