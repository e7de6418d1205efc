"""Token ids of whole texts by the tokenizers library, each distinct space-separated piece encoded once per worker.

A text may be cut before a single space between two characters that aren't white space: neither
pre-tokenizer joins anything across it.  So the ids of a text are those of its pieces in a row.
The library looks for added tokens before all else and treats what stands between them as texts of
their own; a text that holds any is cut around them first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .blocks import remembered

#: Pieces that a worker gathers before it sets the oldest aside (a cache: results don't depend on it).
REMEMBERED = 500_000
#: What ``str.isspace`` says, as a class; empty texts and those with a space that isn't a single one between two other characters.
SPACES = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CROWDED = rf"\A\z|\A{SPACES}| \z| {SPACES}|{SPACES} "
WORD = re.compile(" [^ ]*")
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces of Latin letters, ASCII marks without the apostrophe, and single line ends: each run of letters, with the
#: blank before it, and each run of marks is one pre-token; pre-tokenizers only look ahead, so runs are encoded apart.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(rf" ?[{LETTERS}]+[{MARKS}]*(?:\n[{LETTERS}]+[{MARKS}]*)*")
RUN = re.compile(rf" ?[{LETTERS}]+")
RUNS = re.compile(rf" ?[{LETTERS}]+|[{MARKS}]+|\n")
SIGNS = "".join(re.findall(f"[{MARKS}]", "".join(map(chr, range(128)))))
#: Pieces that one call of the tokenizer gets, and bytes of text that should be encoded together.
CALL, STEP = 4096, 4 << 20


class Encoder:
    """Encodes texts with one tokenizer file, as the library does by default: an added token in a text has its own id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Names that are found in a text as they stand, the longest first; None if some are found in another way, then texts are encoded whole.
        self.added = None if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added) else sorted((t.content for t in added), key=len, reverse=True)
        self.around = re.compile(f"({'|'.join(map(re.escape, self.added))})") if self.added else None
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens, self.closes = (np.zeros(max(names.values()) + 1, bool) for _ in range(2))
        blank = self.encode([" a"])[0]
        for name, number in names.items():
            self.opens[number] = name.startswith("Ġ")  # how byte-level models spell a blank
            self.closes[number] = bool(self.suffix) and name.endswith(self.suffix)
        self.lead = "" if blank == self.encode(["a"])[0] else " "  # a tokenizer that drops white space needs none
        self.line_end = self.encode(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        return remembered(f"encoder {path}", lambda: cls(path))

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def __call__(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Token ids of every text, unsigned 32-bit."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        values = column.to_pylist()
        if self.added is None:
            return [np.array(ids, "<u4") for low in range(0, len(values), CALL) for ids in self.encode(values[low : low + CALL])]
        even = ~np.asarray(pc.match_substring_regex(column, CROWDED).to_numpy(zero_copy_only=False), bool)
        for name in self.added:
            even &= ~np.asarray(pc.match_substring(column, name).to_numpy(zero_copy_only=False), bool)
        odd = {k: b"".join(self._bodies([piece for part in self._apart(values[k]) for piece in CUT.split(part)])) for k in np.flatnonzero(~even).tolist()}
        split = pc.split_pattern(column.filter(pa.array(even)), " ")
        words, at = split.flatten(), np.asarray(split.offsets, np.int64)
        coded = words.dictionary_encode()
        units = self._listed(coded.dictionary)
        unit = np.array(coded.indices, np.int64)
        unit[at[:-1]] = len(units) + np.arange(len(at) - 1)  # nothing stands before the first word of a text
        units += words.take(pa.array(at[:-1])).to_pylist()
        ids, bounds = self._gather(self._bodies(units), unit, at)
        rows = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return [np.frombuffer(odd[k], "<u4") if k in odd else ids[slice(*next(rows))] for k in range(len(values))]

    def _apart(self, text: str) -> list[str]:
        """Added tokens of a text and what stands before, between and after them."""
        return self.around.split(text) if self.around else [text]

    def _listed(self, words: pa.Array) -> list[str]:
        """Words without spaces as a list, the blank before each if the tokenizer keeps it; one conversion for all."""
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        joined = pc.binary_join(whole, " ")[0].as_py()
        if not len(words):
            return []
        return WORD.findall(" " + joined) if self.lead else joined.split(" ")

    @staticmethod
    def _gather(bodies: list[bytes], unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in a row, and where those of each text start and end."""
        pool = np.frombuffer(b"".join(bodies), "<u4")
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        counts = sizes[unit]
        ends = np.concatenate(([0], np.cumsum(counts)))
        places = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[unit] - ends[:-1], counts)
        return pool[places], ends[at]

    def _bodies(self, pieces: list[str]) -> list[bytes]:
        """The ids of every piece; those that aren't known are learned together."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        missing = [k for k, body in enumerate(found) if body is None]
        self._learn([pieces[k] for k in missing])
        for k in missing:
            found[k] = self.known[pieces[k]]
        return found

    def _learn(self, pieces: list[str]) -> None:
        """Makes the ids of all pieces known, by way of their runs where these are encoded apart."""
        known, recall = self.known, self.older.get
        runs, marked, heads, lined, others = [], [], [], [], []
        for piece in dict.fromkeys(pieces):
            if (body := recall(piece)) is not None:
                known[piece] = body
            elif RUN.fullmatch(head := piece.rstrip(SIGNS)):
                if len(head) == len(piece):
                    runs.append(piece)
                else:
                    marked.append(piece)
                    heads.append(head)
            else:
                (lined if SIMPLE.fullmatch(piece) else others).append(piece)
        parts = dict.fromkeys(heads)
        parts.update((piece[len(head) :], None) for piece, head in zip(marked, heads))
        for piece in lined:
            parts.update(dict.fromkeys(RUNS.findall(piece)))
        asked = set(runs)
        for part in parts:
            if part in known or part in asked:
                continue
            if (body := recall(part)) is not None:
                known[part] = body
            else:
                (runs if part[-1].isalpha() else others).append(part)
        others += self._learn_runs([r for r in runs if r[0] == " "], "") + self._learn_runs([r for r in runs if r[0] != " "], "\n")
        for low in range(0, len(others), CALL):
            some = others[low : low + CALL]
            known.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(some, self.encode(some)))
        for piece, head in zip(marked, heads):
            known[piece] = known[head] + known[piece[len(head) :]]
        for piece in lined:
            known[piece] = b"".join(map(known.__getitem__, RUNS.findall(piece)))

    def _learn_runs(self, runs: list[str], between: str) -> list[str]:
        """Learns runs of letters from one text for many, told apart by what opens or closes a word; returns those it couldn't tell apart."""
        missed = []
        for low in range(0, len(runs), CALL):
            part = runs[low : low + CALL]
            ids = np.array(self.encode([between.join(part)])[0], "<u4")
            if self.suffix:
                ends = np.flatnonzero(self.closes[ids]) + 1
                starts = np.concatenate(([0], ends[:-1]))
            elif between:
                gaps = np.flatnonzero(ids == self.line_end[0]) if len(self.line_end) == 1 else np.zeros(0, np.int64)
                starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(ids)]))
            else:
                starts = np.flatnonzero(self.opens[ids])
                ends = np.concatenate((starts[1:], [len(ids)]))
            if len(starts) != len(part):
                missed += part
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))
        return missed
