"""Scripts as a table of tokens: kinds, offsets, lines, and how brackets nest.

A text is cut by one regular expression whose alternatives tile it, so offsets are running
sums of lengths. Files are dealt by row once; a worker lays a file's tokens out from its own
list, and all windows after that work on the file's own rows. Nothing is parsed: what tokens and nesting cannot tell is not told.

Known limits: a slash after ``)`` or ``]`` divides, after other punctuation and some keywords
it begins a regular expression; template strings hold other templates and braces two deep.
A null content has no tokens; a file given twice is one file, files of one path and unlike contents are two.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.nesting import nested, stacked

COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*"
STRING = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*+'|" + r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*+"'
#: Words after which a slash begins a regular expression, and words that name no function.
BEFORE_PATTERN = ("return", "typeof", "case", "delete", "void", "throw", "else", "in", "of")
CLASS = r"\[[^\]\\\n]*(?:\\[^\n][^\]\\\n]*)*+\]"
PATTERN = rf"(?:^|[(,=:\[!&|?{{}};~<>%*+-]|(?:{'|'.join(BEFORE_PATTERN)}))\s*/(?:[^/\\\n\[*]|\\[^\n]|{CLASS})(?:[^/\\\n\[]|\\[^\n]|{CLASS})*+/[a-z]*"
NAME = r"[A-Za-z_$\x{80}-\x{10FFFF}][0-9A-Za-z_$\x{80}-\x{10FFFF}]*"
NUMBER = r"\.?[0-9](?:[eE][+-][0-9]|[0-9A-Za-z_.])*+"


def template(depth: int) -> str:
    """Template strings whose expressions hold braces, strings and templates, ``depth`` deep."""
    inner = rf"[^{{}}`'\"]|{STRING}" + (rf"|{template(depth - 1)}" if depth else "")
    braces = rf"(?:{inner}" + (rf"|\{{(?:{inner})*+\}}" if depth else "") + ")*+"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$+[^{{$`\\]|\$+\\[\s\S]|\$+\{{{braces}\}})*+\$*`"


#: In this order; the last alternative takes any one character.
TOKEN = "|".join([COMMENT, PATTERN, template(2), STRING, NAME, NUMBER, r"\s+", "=>", r"[\s\S]"])


#: Blanks and comments come first.
KINDS = ("space", "comment", "string", "template", "pattern", "number", "name", "sign")
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
TOKEN_FIELDS, NESTED_FIELDS = "place:int,start:int,line:int,kind:string,text:string", ",depth:int,partner:int,parent:int"


def kind_of(text: str) -> str:
    """The kind of a token, by how it begins."""
    first, long = text[0], len(text) > 1
    if first in " \t\n\x0b\f\r":
        return "space"
    if text.startswith(("//", "/*")):
        return "comment"
    if long and first in "'\"`/":
        return {"`": "template", "/": "pattern"}.get(first, "string")
    if re.match(r"\.?[0-9]", text):
        return "number"
    return "name" if re.match(r"[A-Za-z_$\x80-\U0010FFFF]", text) else "sign"


def cut(content: Column) -> Column:
    """A text's tokens in order; a pattern and what it was known by are taken apart."""
    found = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))

    def parts(t: Column) -> Column:
        at = F.instr(t, F.lit("/"))
        head = F.left(t, at - 1)
        sign = F.regexp_replace(head, r"\s+$", "")
        return F.filter(F.array(sign, F.substr(head, F.length(sign) + 1), F.substr(t, at)), lambda x: x != "")

    joined = lambda t: (F.instr(t, F.lit("/")) > 1) & t.rlike(rf"^(?:{PATTERN})$") & ~t.rlike(r"^[/'\"`]")
    return F.flatten(F.transform(found, lambda t: F.when(joined(t), parts(t)).otherwise(F.array(t))))


#: ``TOKEN`` as Python writes it; its blanks are those of Java.
IN_PYTHON = re.compile(TOKEN.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010FFFF"), re.ASCII)
BLANKS = " \t\n\x0b\f\r"


def parts_of_token(t: str) -> list[str]:
    """A pattern and what it was known by, taken apart; the token itself if it is none."""
    at = t.find("/")
    if at < 1 or t[0] in "'\"`":
        return [t]
    sign = t[:at].rstrip(BLANKS)
    return [x for x in (sign, t[len(sign) : at], t[at:]) if x]


def taken_apart(codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray | None]:
    """Tokens and words with patterns taken apart, and how many each token has become; None if none was one."""
    found = {k: parts for k, w in enumerate(words) if "/" in w and len(parts := parts_of_token(w)) > 1}
    if not found:
        return codes, words, None
    numbers = {w: k for k, w in enumerate(words)}
    flat = [k for w in range(len(words)) for k in ([numbers.setdefault(x, len(numbers)) for x in found[w]] if w in found else (w,))]
    sizes = np.array([len(found.get(w, "x")) for w in range(len(words))])
    more = sizes[codes]
    ends = np.cumsum(more)
    return np.array(flat)[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - more), more) + np.arange(ends[-1])], list(numbers), more


def found_in(contents: list[str]) -> pa.ListArray:
    """The lists of ``cut`` as a worker finds them, patterns not yet taken apart: far less is sent to it than tokens are."""
    flat, ends = [], [0]
    for content in contents:
        flat += IN_PYTHON.findall(content)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))


#: Characters of content that a task holds, unless one file has more: as contents, and as tokens, whose sorts take some 400 times as many bytes; what does not fit in memory each of them would spill.
PART_CHARS, TOKEN_CHARS = 1 << 20, 1 << 17
#: The most parts of tokens; Spark allows 100,000 buckets. Beyond 6.5 billion characters parts grow, and spill.
MOST_PARTS = 50_000


def chars_of(corpus: DataFrame) -> int:
    return corpus.agg(F.sum(F.length("content"))).first()[0] or 0


def parts_of(corpus: DataFrame) -> int:
    """Into how many parts the files are dealt, by the size of their contents."""
    return 1 + chars_of(corpus) // PART_CHARS


def token_parts(corpus: DataFrame) -> int:
    """Into how many parts the files are dealt whose tokens are sorted."""
    return min(MOST_PARTS, 1 + chars_of(corpus) // TOKEN_CHARS)


def files_of(corpus: DataFrame, parts: int | None = None) -> DataFrame:
    """``file, path, content`` of every file, dealt by ``file``: a digest of path and content, so that it is the same wherever it is computed.

    Their number of parts is set (``parts_of``, unless given): Spark would choose it by the contents, which are small beside the tokens that come of them.
    """
    digest = F.unhex(F.md5(F.concat_ws("\0", "path", "content").cast("binary")))
    return corpus.where("content IS NOT NULL").select(digest.alias("file"), "path", "content").repartition(parts or parts_of(corpus), "file").dropDuplicates(["file"])


def numbered(lists: pa.ListArray, blanks: bool) -> tuple:
    """Of lists of ``cut`` or ``found_in``: how many tokens each has, their offsets, lines, kinds (by ``KINDS``) and words by number, the words, and the list and the place of each."""
    text, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    coded = text.dictionary_encode()
    codes, words, more = taken_apart(coded.indices.to_numpy(), coded.dictionary.to_pylist())
    if more is not None:
        of = np.repeat(of, more)
        counts = np.bincount(of, minlength=len(counts))

    def before(sizes: list[int]) -> np.ndarray:
        """The sum of what stands before each token in its file."""
        summed = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[codes])])
        return summed[:-1] - summed[np.cumsum(counts) - counts][of]

    start, line = before([len(w) for w in words]), before([w.count("\n") for w in words]) + 1
    kind = np.array([KINDS.index(kind_of(w)) for w in words], np.int64)[codes]
    if not blanks:
        kept = kind > 1
        start, line, kind, of, codes = start[kept], line[kept], kind[kept], of[kept], codes[kept]
        counts = np.bincount(of, minlength=len(counts))
    return counts, start, line, kind, codes, words, of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def stacks(codes: np.ndarray, words: list[str], of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``depth``, ``partner`` and ``parent`` of the tokens of ``numbered``."""
    return stacked(np.array([1 if w in OPEN else -1 if w in CLOSE else 0 for w in words], np.int8)[codes], of, place)


def laid_out(lists: pa.ListArray, blanks: bool, nest: bool) -> pa.ListArray:
    """Lists of ``cut`` as lists of ``TOKEN_FIELDS``, with ``NESTED_FIELDS`` if ``nest``."""
    counts, start, line, kind, codes, words, of, place = numbered(lists, blanks)
    columns = {"place": place, "start": start, "line": line, "kind": pa.array(KINDS).take(pa.array(kind)), "text": pa.array(words, pa.string()).take(pa.array(codes))}
    if nest:
        columns |= dict(zip(("depth", "partner", "parent"), stacks(codes, words, of, place), strict=True))
    arrays = [pa.array(x, pa.int32(), mask=x < 0) if isinstance(x, np.ndarray) else x for x in columns.values()]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, list(columns)))


def rows_of(corpus: DataFrame, parts: int | None, blanks: bool, nest: bool) -> DataFrame:
    """Tokens of each file from its own list: none is sorted, and they stay where their file was dealt to."""

    @F.arrow_udf(f"array<struct<{TOKEN_FIELDS}{NESTED_FIELDS if nest else ''}>>")
    def laid(found: pa.Array) -> pa.Array:
        return laid_out(found, blanks, nest)

    return files_of(corpus, parts or token_parts(corpus)).select("file", "path", F.inline(laid(cut(F.col("content")))))


def all_tokens(corpus: DataFrame, parts: int | None = None) -> DataFrame:
    """``file, path, place, start, line, kind, text`` of every token, blanks and comments too."""
    return rows_of(corpus, parts, True, False)


def tokens(corpus: DataFrame, parts: int | None = None) -> DataFrame:
    """The tokens that are neither blanks nor comments, their places counted from 0 without those."""
    return rows_of(corpus, parts, False, False)


def bracketed_tokens(corpus: DataFrame, parts: int | None = None) -> DataFrame:
    """``bracketed(tokens(corpus))``, a file's brackets paired where its tokens are laid out."""
    return rows_of(corpus, parts, False, True)


def is_open(text: Column) -> Column:
    return text.isin(*OPEN)


def is_close(text: Column) -> Column:
    return text.isin(*CLOSE)


def bracketed(rows: DataFrame) -> DataFrame:
    """``tokens`` with ``depth``, ``partner`` and ``parent`` by brackets of all kinds."""
    return nested(rows, ["file"], "place", is_open(F.col("text")), is_close(F.col("text")))


def literal(text: Column) -> Column:
    """What a string stands for: without its quotes, escaped quotes and backslashes plain."""
    return F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"\\(['\"\\])", "$1")
