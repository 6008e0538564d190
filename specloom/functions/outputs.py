"""Column functions over model outputs: JSON payloads, final structures, behaviour, token traces.

JSON is read by one Arrow UDF, which follows nesting of any depth; all else runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks between fences, and the labels before a final structure, in order of preference.
JSON_FENCE = r"(?is)```(?:json)?\s*\n?(.*?)```"
TEXT_FENCE = r"(?is)```(?:plaintext|text|smiles)?\s*\n?(.*?)```"
LABELS = ("Final canonical SMILES", "Final SMILES", "Canonical SMILES", "SMILES")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines that aren't blank, without white space at their ends."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != "")


def _reader():
    """The Arrow UDF behind read(); it is closed in itself, so that workers needn't have this package."""
    fence = JSON_FENCE.removeprefix("(?is)")

    @F.pandas_udf("payload string, has_smiles boolean, smiles string")
    def look(texts: pd.Series) -> pd.DataFrame:
        import json
        import re

        blocks = re.compile(fence, re.IGNORECASE | re.DOTALL)

        def load(text):
            """The JSON value and whether it is one; what is nested too deep for the parser isn't."""
            try:
                return json.loads(text), True
            except (ValueError, RecursionError):
                return None, False

        def search(value):
            """Whether the key smiles is there, and its first value that isn't empty; a stack holds what is still to be seen."""
            has, stack = False, [value]
            while stack:
                value = stack.pop()
                if isinstance(value, list):
                    stack.extend(reversed(value))
                elif isinstance(value, dict):
                    if "smiles" in value:
                        has = True
                        found = value["smiles"]
                        if found is not None and (found := str(found).strip()):
                            return True, found
                    else:
                        inner = value.get("arguments")
                        stack += [value.get("function"), load(inner)[0] if isinstance(inner, str) else inner]
            return has, None

        out = []
        for text in texts:
            text = "" if text is None else text.strip()
            row = (None, None, None)
            for part in (text, *(x.strip() for x in blocks.findall(text))):
                value, parsed = load(part) if part else (None, False)
                if parsed:
                    row = row if value is None else (part, *search(value))
                    break
            out.append(row)
        return pd.DataFrame(out, columns=["payload", "has_smiles", "smiles"], dtype=object)

    return look


def read(text: Column) -> Column:
    """The JSON payload of a response as a struct: payload, has_smiles, smiles; all null without one.

    The payload is the text, or else the first fenced block in it, that parses as JSON; null is none. The key smiles is looked
    for in an object, or else in its arguments (JSON text or an object), then in its function, and in the items of lists, at
    any depth; the first value that isn't null or empty counts.
    """
    return _reader()(text)


def payload(text: Column) -> Column:
    """The text, or else the first fenced block in it, that parses as JSON; null if none does."""
    return read(text)["payload"]


def final_smiles(text: Column) -> Column:
    """The structure that a response gives: from JSON, or after a label, or first in a fenced block, or its last line."""
    json = read(text)
    labelled = [F.nullif(F.regexp_extract(text, rf"(?i){label}\s*:\s*([^\s`]+)", 1), F.lit("")) for label in LABELS]
    blocks = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TEXT_FENCE), F.lit(1)), lambda b: F.slice(lines(b), 1, 1)))
    plain = F.filter(lines(text), lambda x: ~x.startswith("```"))
    last = F.when(F.size(plain) > 0, F.element_at(plain, -1))
    return F.when(json["payload"].isNotNull(), json["smiles"]).otherwise(F.coalesce(*labelled, F.get(blocks, 0), last))


def output_state(text: Column, valid: Callable[[Column], Column]) -> Column:
    """One of compliant, invalid and non_bare. valid says whether a structure is one."""
    body = strip(text)
    json = read(text)
    smiles, found = json["smiles"], json["payload"].isNotNull()
    bare = (body != "") & ~body.rlike(r"[\s`:]")
    return (
        F.when(found & ~json["has_smiles"], F.lit("non_bare"))
        .when(found & smiles.isNull(), F.lit("compliant"))
        .when(found, F.when(valid(smiles), F.lit("compliant")).otherwise(F.lit("invalid")))
        .when(bare & ~valid(body), F.lit("invalid"))
        .otherwise(F.lit("non_bare"))
    )


def trace(tokens: Column, eos: int, max_new: int) -> list[Column]:
    """Tokens up to the first end token, whether it came, whether the limit was hit without it, and whether a 4-gram
    repeats three times or more."""
    at = F.array_position(tokens, eos)
    kept = F.when(at > 0, F.slice(tokens, 1, at.cast("int"))).otherwise(tokens)
    ended = at > 0
    n = F.size(kept)
    return [n, ended, ~ended & (n >= max_new), F.coalesce(repeated(kept, 4, 3), F.lit(False))]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def repeated(values: Column, n: int, times: int) -> Column:
    """Whether any n-gram of the array comes so many times: among sorted n-grams, equal ones stand together."""

    def places(first: int, last: Column) -> Column:
        return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))

    def grams(v: Column) -> Column:
        return F.array_sort(F.transform(places(1, F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n).cast("array<string>"), " ")))

    def often(g: Column) -> Column:
        return F.exists(places(0, F.size(g) - times), lambda i: F.get(g, i) == F.get(g, i + (times - 1)))

    return let(values, lambda v: let(grams(v), often))
