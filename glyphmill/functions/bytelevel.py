"""Byte-level pre-tokens and symbols.

A pre-token's bytes become symbol ids by arithmetic: after the special tokens
come the 256 bytes, ordered by the printable character that stands for each.
Printable bytes stand for themselves; the others take the characters from 256
on, in byte order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and order of the special tokens (ids 0-6).
SPECIAL_TOKENS = (
    "<|pad|>",
    "<|unk|>",
    "<|startoftext|>",
    "<|endoftext|>",
    "<|mermaid|>",
    "<|prompt|>",
    "<|response|>",
)
PAD, UNK, START, EOT, DIAGRAM, PROMPT, RESPONSE = range(len(SPECIAL_TOKENS))
FIRST_BYTE = len(SPECIAL_TOKENS)
FIRST_MERGE = FIRST_BYTE + 256

# Fixed value: the public byte-level pre-token pattern.  (?U) gives \s its
# Unicode meaning.
PRETOKEN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Byte ranges that are printable, as (first, last, id of first).
_PRINTABLE = ((33, 126, 0), (161, 172, 94), (174, 255, 106))
_HIDDEN = ((0, 32, 188), (127, 160, 221), (173, 173, 255))


def byte_offsets() -> list[int]:
    """Position of each byte in the byte part of the vocabulary."""
    out = [0] * 256
    for low, high, start in _PRINTABLE + _HIDDEN:
        for b in range(low, high + 1):
            out[b] = start + b - low
    return out


def byte_characters() -> list[str]:
    """The character each byte is shown as."""
    printable = {b for low, high, _ in _PRINTABLE for b in range(low, high + 1)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


# Names of special tokens inside a text, and the places right before and after one.
_NAME = "|".join(t.replace("|", r"\|") for t in SPECIAL_TOKENS)
_AROUND = f"(?={_NAME})|(?<={_NAME})"


def pretokens(text: Column, specials: bool = False) -> Column:
    """Pre-tokens of a text, in order; together they are the text.

    With ``specials`` every name of a special token is a pre-token of its own,
    and what stands before and after it is cut as if it were a text alone.
    """
    plain = F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))
    if not specials:
        return plain
    parts = F.filter(F.split(text, _AROUND), lambda part: part != "")
    cut = F.transform(
        parts,
        lambda part: F.when(part.isin(*SPECIAL_TOKENS), F.array(part)).otherwise(
            F.regexp_extract_all(part, F.lit(PRETOKEN), F.lit(0))
        ),
    )
    return F.when(F.contains(text, F.lit("<|")), F.flatten(cut)).otherwise(plain)


def pieces(text: Column) -> Column:
    """The text cut before every blank or line break that follows a printable ASCII character: no pre-token crosses there.

    White space is a pre-token of its own or its last blank begins one, and what
    the pattern looks ahead for is inside the piece; so the pre-tokens of the
    pieces are those of the text.
    """
    return F.split(text, r"(?<=[!-~])(?=[ \n])")


def symbols(pretoken: Column) -> Column:
    """A pre-token as `` id  id  id ``: every symbol id between two blanks.

    With a blank on both sides of every id, merging a pair is one literal
    replacement of `` a  b `` by `` ab ``.
    """
    ids = F.split(F.lit(",".join(str(FIRST_BYTE + o) for o in byte_offsets())), ",")
    pairs = F.split(F.trim(F.regexp_replace(F.hex(F.encode(pretoken, "UTF-8")), "(..)", "$1 ")), " ")
    coded = F.transform(pairs, lambda h: F.element_at(ids, F.conv(h, 16, 10).cast("int") + 1))
    return F.concat(F.lit(" "), F.array_join(coded, "  "), F.lit(" "))


def symbol_ids(symbol_text: Column) -> Column:
    return F.split(F.trim(F.replace(symbol_text, F.lit("  "), F.lit(" "))), " ").cast("array<int>")
