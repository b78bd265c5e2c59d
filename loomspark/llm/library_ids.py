"""Token ids of whole texts by the tokenizers and sentencepiece libraries, each distinct piece encoded once.

Neither vocabulary has a token that goes on over a blank into the next word, so a text may be
cut before every blank that follows or precedes other than white space, and its ids are those
of its segments one after the other. Arrow cuts the texts and numbers the distinct segments;
only segments that a worker has not met are given to the library. Texts with longer runs of
white space are cut by the vocabulary's own rule for such runs, and texts that hold a special
string, where that counts as one token, are given to the library whole.

Workers keep the ids of segments from task to task, up to ``most`` segments; the table is
emptied when it is full, which changes no id. Ids are uint32.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomspark.llm.bpe_count import byte_symbols

#: Segments whose ids a worker keeps, unless told otherwise.
MEMO = 1 << 20
#: Words given to the library in one string.
TOGETHER = 128
#: Fixed value: white space as the vocabulary's pattern understands it.
BLANKS = "\t-\r \x85\xa0  -     　"
#: Texts that cannot be cut before each blank.
ODD = f"[{BLANKS}] [{BLANKS}]|  |^ | $"
RUNS = re.compile(f"[{BLANKS}]+(?![^{BLANKS}])| ?[^{BLANKS}]+|[{BLANKS}]")
SPACED = re.compile(" +[^ ]*")
#: Libraries that this worker has loaded, by what they were loaded from.
_LOADED: dict = {}


def once(kind: Callable, data: bytes, *options):
    """``kind(data, *options)``, made once in a worker."""
    key = (kind, hashlib.sha256(data).digest(), options)
    if key not in _LOADED:
        _LOADED[key] = kind(data, *options)
    return _LOADED[key]


class Encoder:
    """Ids of texts from ids of segments. ``lead``: every text has a blank put before it."""

    lead = False

    def __init__(self, most: int = MEMO):
        self.memo: dict[str, bytes] = {}
        self.most = most

    def segments(self, text: str) -> list[str]:
        raise NotImplementedError

    def new_ids(self, segments: list[str]) -> list[bytes]:
        raise NotImplementedError

    def entries(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as bytes."""
        if len(self.memo) + len(segments) > self.most:
            self.memo.clear()
        found = list(map(self.memo.get, segments))
        places = [k for k, ids in enumerate(found) if ids is None]
        missing = [segments[k] for k in places]
        new = self.new_ids(missing)
        self.memo.update(zip(missing, new, strict=True))
        for k, ids in zip(places, new, strict=True):
            found[k] = ids
        return found

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct segments, the numbers of all texts' segments in order, and how many each text has."""
        column = pa.array(texts, pa.large_string())
        odd = pc.or_(pc.match_substring_regex(column, ODD), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        odd |= np.fromiter((self.whole(t) for t in texts), bool, len(texts))
        words = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded = words.flatten().dictionary_encode()
        known = [" " + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        numbers: dict[str, int] = {}
        number = lambda s: len(known) + numbers.setdefault(s, len(numbers))
        if not self.lead:
            firsts = np.cumsum(counts[~odd]) - counts[~odd]
            codes[firsts] = [number(known[c][1:]) for c in codes[firsts].tolist()]
        if odd.any():
            parts, at = [], 0
            for k, text in enumerate(texts):
                if odd[k]:
                    cut = [number(s) for s in self.segments(text)]
                    counts[k] = len(cut)
                    parts.append(np.array(cut, np.int64))
                else:
                    parts.append(codes[at : at + counts[k]])
                    at += counts[k]
            codes = np.concatenate(parts)
        return known + list(numbers), codes, counts

    def whole(self, text: str) -> bool:
        """Whether the library has to see the text uncut."""
        return False

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has."""
        segments, codes, counts = self.cut(texts)
        ids = self.entries(segments)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lengths, stops = sizes[codes], np.cumsum(sizes)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat((stops - sizes)[codes] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate(([0], ends))
        texts_at = np.concatenate(([0], np.cumsum(counts)))
        return out, np.diff(bounds[texts_at])


class ByteLevelIds(Encoder):
    """Ids of a byte-level vocabulary of the tokenizers library, given as the bytes of its file."""

    def __init__(self, data: bytes, lead: bool = False, specials_are_text: bool = False, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer, self.lead = Tokenizer.from_str(data.decode("utf-8")), lead
        self.tokenizer.encode_special_tokens = specials_are_text
        specials = [] if specials_are_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.sizes = np.array([len(b) for b in self.bytes_of_ids()])

    def whole(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None

    def segments(self, text: str) -> list[str]:
        text = " " + text if self.lead and text else text
        return [text] if self.whole(text) else RUNS.findall(text)

    def new_ids(self, segments: list[str]) -> list[bytes]:
        """Words behind one blank are given to the library many at once, since none of them is joined to the next; other segments one by one."""
        out: list[bytes] = [b""] * len(segments)
        plain = [k for k, s in enumerate(segments) if s[0] == " " and s.split() == [s[1:]]]
        lengths = pc.binary_length(pa.array(segments, pa.large_string())).to_numpy(zero_copy_only=False)
        runs = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        encode = self.tokenizer.encode_batch_fast
        for k in range(0, len(runs), 32):
            for run, found in zip(runs[k : k + 32], encode(["".join([segments[i] for i in run]) for run in runs[k : k + 32]], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.uint32)
                ends = np.cumsum(lengths[run])
                stops = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
                data, at = ids.tobytes(), 0
                for i, stop in zip(run, stops.tolist(), strict=True):
                    out[i], at = data[at:stop], stop
        rest = [k for k, x in enumerate(out) if not x]
        for k, found in zip(rest, encode([segments[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = array("I", found.ids).tobytes()
        return out

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes that each id stands for."""
        byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        n = self.tokenizer.get_vocab_size()
        return [self.tokenizer.id_to_token(i).translate(byte).encode("latin-1") for i in range(n)]


class PieceIds(Encoder):
    """Ids of a sentencepiece model, given as the bytes of its file; the model puts the blank before a text itself."""

    lead = True

    def __init__(self, data: bytes, most: int = MEMO):
        import sentencepiece

        super().__init__(most)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def segments(self, text: str) -> list[str]:
        return SPACED.findall(" " + text) if text else []

    def new_ids(self, segments: list[str]) -> list[bytes]:
        plain = [s[1:] for s in segments]
        ids = self.model.encode(plain, num_threads=1) if plain else []
        alone = self.model.piece_to_id("▁")
        return [array("I", i if p else [alone]).tobytes() for i, p in zip(ids, plain, strict=True)]

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes that each id stands for."""
        m = self.model
        piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        return [piece(i) for i in range(m.vocab_size())]
