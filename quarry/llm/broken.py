"""Source files that are not valid in the language of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.files import assemble, file_parts
from quarry.llm.grammars import parses
from quarry.llm.languages import EXTENSIONS, extension, rank_languages
from quarry.sources.session import map_arrow

def judge(path: str | None, text: str) -> tuple[str | None, bool, str | None, str | None]:
    """(language, valid, cause, reads_as) of a file.

    The language is that of the extension, letter case ignored; None, and valid, where there is no grammar. A blank
    file is valid. Every other text is parsed by all grammars, in the order of its languages by tokens. It is valid if
    that of its extension accepts it. Else the first other that does tells a wrong extension (cause `extension`,
    reads_as that language); if all refuse, or only those do not that accept nearly any text, it is `corrupt`. These are
    PHP, to which text without its opening tag is plain, and Bash, to which most words are commands: they count where the tag
    stands and where the text has more tokens of Bash than of the named language. A file whose most tokens are of a format without a grammar here (HTML,
    Markdown) is of cause `extension` as well."""
    named = EXTENSIONS.get(extension(path))
    if named is None or not text.strip():
        return named, True, None, None
    ranked = rank_languages(text)
    accepted = [g for g in dict.fromkeys([*ranked, *EXTENSIONS.values()]) if g in EXTENSIONS.values() and parses(text, g)]
    if named in accepted:
        return named, True, None, None
    above = ranked[: ranked.index(named)] if named in ranked else ranked
    told = [g for g in accepted if (g != "php" or "<?php" in text) and (g != "sh" or g in above)]
    if ranked and ranked[0] not in EXTENSIONS.values():
        return named, False, "extension", ranked[0]
    return (named, False, "extension", told[0]) if told else (named, False, "corrupt", None)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [judge(p, assemble(parts)) for p, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        lang, valid, cause, reads = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(valid, pa.bool_()), pa.array(cause, pa.string()), pa.array(reads, pa.string())],
            names=["repo", "file_path", "language", "valid", "cause", "reads_as"],
        )


def judged_files(chunks: DataFrame) -> DataFrame:
    """(repo, file_path, language, valid, cause, reads_as) of every file in a language with a grammar here.

    Files are put together from all their whole chunks by one shuffle on repo and path and parsed where they
    land; nothing is collected or broadcast. Rows delivered twice count once; null contents are empty."""
    known = F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1)).isin(list(EXTENSIONS))
    return map_arrow(file_parts(chunks.where(known)), _judged, "repo string, file_path string, language string, valid boolean, cause string, reads_as string")


def broken_rates(judged: DataFrame) -> DataFrame:
    """Per repository and language: files, broken ones, those with a wrong extension, and the broken share."""
    out = judged.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_broken"), F.sum((F.coalesce("cause", F.lit("")) == "extension").cast("long")).alias("n_wrong_extension")
    )
    return out.withColumn("share", F.round(F.col("n_broken") / F.col("n_files"), 6))
