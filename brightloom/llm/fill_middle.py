"""Fill-in-middle transformation of documents, in an Arrow-batched pandas UDF.

A text is cut into units by one pattern: ``regex``'s finditer passes over it once, and
where units end stands in a compact array, four bytes a unit. Two cuts, drawn from a
SHA-256 of seed and id, are two look-ups in it and slice the text into prefix, middle
and suffix. The result depends on id, text and parameters only, so a task that is run
again writes the same rows.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, read_table, row_of, ship

SEED = 42
#: Per cent of the texts that are transformed, and of these in the order suffix, prefix, middle.
PERCENT, SPM_PERCENT = 50, 80
#: Words with the white space before them, and white space that no word follows.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Cut(NamedTuple):
    n: int
    form: str
    prefix: str | None
    middle: str | None
    suffix: str | None


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from seed and id; an id that is null is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut_text(doc_id: int | None, text: str, units: regex.Pattern, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> Cut:
    """Units of a text, its form, and its three parts where it is not plain.

    What no unit covers belongs to the unit before it; with UNITS there is nothing such.
    """
    ends = array("I", [m.end() for m in units.finditer(text)])
    n = len(ends)
    a, b, transformed, order = draws(doc_id, seed)
    if not text or transformed % 100 >= percent or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, PLAIN, None, None, None)
    low, high = (ends[k - 1] if k else 0 for k in sorted((a % (n + 1), b % (n + 1))))
    return Cut(n, SPM if order % 100 < spm_percent else PSM, text[:low], text[low:high], text[high:])


def assembled(text: str, cut: Cut) -> str:
    """The text in its form."""
    if cut.form == PSM:
        return f"{PREFIX}{cut.prefix}{SUFFIX}{cut.suffix}{MIDDLE}{cut.middle}"
    if cut.form == SPM:
        return f"{SUFFIX}{cut.suffix}{PREFIX}{cut.prefix}{MIDDLE}{cut.middle}"
    return text


def restored(output: str, form: str) -> str:
    """The exact text, from output and form. A transformed text holds each mark once."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == PSM else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, pattern: str = UNITS, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the ``carry`` columns, all by default), n (units), form,
    prefix_chars and middle_chars (code points; null if plain), output and output_sha256.

    Null and empty texts are empty and plain, and so is a text that holds one of the
    three marks, which could not be told from its own. Texts are whole, however long.
    Rows of equal id and text get equal results; a null id draws numbers of its own.
    Columns may have any names: they travel inside ``row``. An empty table gives an
    empty table.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def transform(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units, out = regex.compile(pattern), []
        for doc_id, t in zip(ids, texts, strict=True):
            cut = cut_text(None if doc_id is None else int(doc_id), t, units, seed, percent, spm_percent)
            output = assembled(t, cut)
            sizes = (None, None) if cut.prefix is None else (len(cut.prefix), len(cut.middle))
            out.append((cut.n, cut.form, *sizes, output, _sha256(output)))
        found = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # ids travel as text: a batch with a null among whole numbers would make them floats
    source = docs.select(row_of(docs.columns if carry is None else carry), named(id_col).cast("bigint").cast("string").alias("id"), F.coalesce(named(text), F.lit("")).alias("text"))
    return source.select("row", transform("id", "text").alias("x")).select("row", "x.*")


def with_restored(transformed: DataFrame) -> DataFrame:
    """Adds restored, the text that output and form say it was, and restored_sha256."""
    ship(transformed.sparkSession)

    @F.pandas_udf("restored string, restored_sha256 string")
    def back(output: pd.Series, form: pd.Series) -> pd.DataFrame:
        texts = [restored(o, f) for o, f in zip(output, form, strict=True)]
        return pd.DataFrame({"restored": texts, "restored_sha256": map(_sha256, texts)}, dtype=object)

    return transformed.select("*", back("output", "form").alias("y")).select(*transformed.columns, "y.*")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_restored(fill_in_middle(read_table(spark, sf_dir, "documents"), carry=["doc_id"]))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
