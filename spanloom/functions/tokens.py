"""Tokenisation: text to an array of typed tokens with byte and character spans, in the row and without a shuffle.

By default whole Arrow batches are tokenised as arrays (:mod:`spanloom.functions.batches`). The native way stays in the
JVM: one regular expression finds pieces (skipped white space plus one token); pieces concatenate to the text, so running
sums of their lengths give the spans. The sums run over blocks of tokens that are read by index, so they are linear in
the text up to 64 cubed tokens. The same rules exist as a plain Python tokenizer for the table function and for tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token types in priority order with their patterns.
RULES = [
    ("Russian", r"[А-Яа-яЁё]+"),
    ("Email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("Phone", r"(?:\+?\d{10,14}|\+?\d[\s_-]?\(?\d{3}\)?(?:[\s_-]?\d{2,4}){3})"),
    ("Domain", r"(?:[a-zA-Z0-9-]+\.)+[a-zA-Z][a-zA-Z0-9-]*"),
    ("Latin", r"[a-zA-Z]+"),
    ("Int", r"\d+"),
    ("Punct", r"""[-\\/!#$%&()\[\]*+,.:;<=>?@^_`{|}~…"'«»„“ʼʻ”]"""),
    ("EOL", r"[\n\r]+"),
    ("Other", r"\S"),
]
TOKEN_TYPES = [name for name, _ in RULES]
ANY_TOKEN = "|".join(p for _, p in RULES)
PIECE = rf"[^\S\n\r]*(?:{ANY_TOKEN})"
#: The same for Java, without backtracking where it cannot help.
_PIECE = "(?U)" + PIECE.replace(r"[^\S\n\r]*", r"[^\S\n\r]*+", 1).replace("_.+-]+@", "_.+-]++@")
#: White space but line ends: what a piece may start with.
BLANK = SKIPPED = "\t\x0b\x0c \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Tokens of a block of the running sums.
BLOCK = 64

FORM = "struct<lemma:string,grams:array<string>,lemma_id:bigint,form:string>"
TOKEN = f"struct<idx:int,value:string,token_type:string,byte_start:int,byte_stop:int,char_start:int,char_stop:int,forms:array<{FORM}>,tag:string>"


def _lit(pattern: str) -> str:
    return "(?U)" + pattern


def split_values(text: Column) -> Column:
    """array<string> of token values; null text gives null."""
    return F.regexp_extract_all(text, F.lit(_lit(ANY_TOKEN)), F.lit(0))


def type_of(value: Column) -> Column:
    """The token type is the first rule that matches the whole value; frequent types that exclude each other come first."""
    full = {name: value.rlike(rf"(?U)\A(?:{pattern})\z") for name, pattern in RULES}
    order = ["Latin", "Russian", "Punct", "EOL", "Email", "Phone", "Domain", "Int"]
    out = F.when(full[order[0]], order[0])
    for name in order[1:]:
        out = out.when(full[name], name)
    return out.otherwise("Other")


def running(values: Column, combine=lambda a, b: a + b) -> Column:
    """Inclusive running values of an array of ints under an associative operation (sums by default), by blocks of BLOCK.

    The values are bound to a name first, as they are read by index: an expression would be computed once an element.
    """
    step = lambda acc, x: F.coalesce(combine(acc, x), x)  # noqa: E731  # nothing stands before the first value

    def within(start: Column, stop: Column, get) -> Column:
        """Running values of get(start) up to get(stop) as an array."""
        first = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, i: Column) -> Column:
            now = step(acc["last"], get(i))
            return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

        return F.aggregate(F.sequence(start, stop), first, add, lambda acc: acc["out"])

    def level(get, size: Column, depth: int) -> Column:
        """Running values of get(0) up to get(size - 1)."""
        last = (size - 1).cast("int")
        if not depth:
            return within(F.lit(0), last, get)
        count = F.floor(last / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: within(b * BLOCK, F.least(b * BLOCK + (BLOCK - 1), last), get))

        def joined(acc: Column, blocks: Column) -> Column:
            # each block moved by what stands before it
            return F.flatten(F.zip_with(blocks, acc, lambda block, base: F.transform(block, lambda x: step(base, x))))

        def shifted(blocks: Column) -> Column:
            bases = level(lambda i: F.element_at(F.get(blocks, i), -1), F.size(blocks), depth - 1)
            before = F.concat(F.array(F.lit(None).cast("int")), bases)
            return joined(F.slice(before, F.lit(1), F.size(blocks)), blocks)

        # a one-element array binds the blocks to a name, so that they are made once
        return F.get(F.transform(F.array(blocks), shifted), F.lit(0))

    def over(values: Column) -> Column:
        return F.when(F.size(values) > 0, level(lambda i: F.get(values, i), F.size(values), 2)).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(values), over), F.lit(0))


def fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that the optimiser does not merge into later expressions.

    A column that is read inside a lambda would otherwise be computed again for each element. A one-element
    generator keeps the projections apart, on streams too.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def with_tokens(df: DataFrame, text_col: str = "text", into: str = "tokens", native: bool = False) -> DataFrame:
    """``df`` with ``into``, an array of TOKEN; null text gives null, empty text an empty array. forms and tag are null.

    ``native``: without Python workers, at about a tenth of the speed.
    """
    if native:
        return _native_tokens(df, text_col, into)
    from spanloom.functions.batches import token_arrays

    made = F.arrow_udf(token_arrays, f"array<{TOKEN}>")
    return df.withColumn(into, made(F.col(text_col)))


def _native_tokens(df: DataFrame, text_col: str, into: str) -> DataFrame:
    text = F.col(text_col)
    pieces = fixed(df, {"__pieces": F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))})
    pieces = fixed(pieces, {"__stops": running(F.transform("__pieces", lambda p: F.octet_length(p)))})
    one_byte = F.octet_length(text) == F.char_length(text)  # then both kinds of spans are the same
    parts = F.arrays_zip(
        F.transform("__pieces", lambda p: F.ltrim(p, F.lit(SKIPPED))).alias("value"),
        F.col("__stops").alias("byte_stop"),
        F.when(one_byte, F.col("__stops")).otherwise(running(F.transform("__pieces", lambda p: F.char_length(p)))).alias("char_stop"),
    )

    def token(z: Column, i: Column) -> Column:
        value = z["0"]
        return F.struct(
            i.alias("idx"), value.alias("value"), type_of(value).alias("token_type"),
            (z["1"] - F.octet_length(value)).alias("byte_start"), z["1"].alias("byte_stop"),
            (z["2"] - F.char_length(value)).alias("char_start"), z["2"].alias("char_stop"),
            F.lit(None).cast(f"array<{FORM}>").alias("forms"), F.lit(None).cast("string").alias("tag"),
        )

    parted = fixed(pieces, {"__parts": parts.cast("array<struct<`0`:string,`1`:int,`2`:int>>")})
    return fixed(parted, {into: F.transform("__parts", token)}).drop("__pieces", "__stops", "__parts")


def token_rows(df: DataFrame, keep: list[str], tokens_col: str = "tokens") -> DataFrame:
    """One row a token: the columns ``keep`` and the token's fields."""
    return df.select(*keep, F.inline(tokens_col))


#: Fields of a token row and their types.
ROW = {"idx": "int", "value": "string", "token_type": "string", "byte_start": "int", "byte_stop": "int", "char_start": "int", "char_stop": "int"}


def tokenised(df: DataFrame, keep: list[str], fields=tuple(ROW), text_col: str = "text") -> DataFrame:
    """One row a token with ``keep`` and some fields of ROW, without an array of tokens in between; null texts give none."""
    from spanloom.functions.batches import row_arrays, slices

    fields, names = list(fields), [*keep, *fields]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(len(keep))):
                owner, columns = row_arrays(batch.column(len(keep)).slice(a, b - a), fields)
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a).take(owner) for c in batch.columns[: len(keep)]], *columns], names=names)

    own = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, text_col).mapInArrow(run, ", ".join([*own, *[f"{f} {ROW[f]}" for f in fields]]))


def retokened(df: DataFrame, change, tokens_col: str = "tokens") -> DataFrame:
    """Apply a tagger, a Column function from the token array to a token array, and number the tokens anew."""
    return df.withColumn(tokens_col, F.transform(change(F.col(tokens_col)), lambda t, i: t.withField("idx", i)))


# values of tokens


def is_capitalised(value: Column) -> Column:
    return value.rlike(r"(?U)\A\p{IsUppercase}")


def normalised_token(token: Column) -> Column:
    """First form's lemma; a capitalised token prefers a form with Surn; without forms the lower-case value."""
    surname = F.get(F.filter(token["forms"], lambda f: F.array_contains(f["grams"], "Surn")), F.lit(0))["lemma"]
    first = F.get(token["forms"], F.lit(0))["lemma"]
    return F.coalesce(F.when(is_capitalised(token["value"]), surname), first, F.lower(token["value"]))


def join_with_gaps(tokens: Column, value=lambda t: t["value"]) -> Column:
    """Values joined, with one space wherever the text has a gap between two tokens; empty for no tokens."""
    gap = lambda t, i: F.when((i > 0) & (t["byte_start"] > F.get(tokens, i - 1)["byte_stop"]), F.lit(" ")).otherwise(F.lit(""))
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(gap(t, i), value(t))), "")


def join_normalised(tokens: Column) -> Column:
    return join_with_gaps(tokens, normalised_token)


def cut(tokens: Column, start: Column, stop: Column) -> Column:
    """Tokens from start up to stop, read by index: slice() copies the whole array for each call."""
    return F.when(stop > start, F.transform(F.sequence(start, stop - 1), lambda i: F.get(tokens, i))).otherwise(F.slice(tokens, 1, 0))


def tokens_span(tokens: Column) -> Column:
    """start and stop in bytes from the first to the last token; null for no tokens."""
    return F.when(F.size(tokens) > 0, F.struct(F.get(tokens, F.lit(0))["byte_start"].alias("start"), F.element_at(tokens, -1)["byte_stop"].alias("stop")))


# plain Python tokens, for the table function and for local parsing


@dataclass
class Token:
    value: str
    token_type: str
    byte_start: int
    byte_stop: int
    char_start: int
    char_stop: int
    forms: list[dict] | None = None
    tag: str | None = None
    idx: int = field(default=0)


#: White space is spelled out: Python's ``\\s`` has four control characters more.
_ALL = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in RULES).replace(r"[\s_-]", f"[{BLANK}\n\r_-]").replace(r"\S", f"[^{BLANK}\n\r]"))


def local_tokens(text: str) -> list[Token]:
    """The same tokens in plain Python."""
    out, at, byte = [], 0, 0
    for i, m in enumerate(_ALL.finditer(text)):
        start = byte + len(text[at : m.start()].encode())
        byte, at = start + len(m[0].encode()), m.end()
        out.append(Token(m[0], m.lastgroup, start, byte, m.start(), m.end(), idx=i))
    return out
