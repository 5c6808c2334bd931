"""Generated, minified or vendored source files, and data saved as code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.files import assemble, file_parts
from quarry.llm.minhash import mix
from quarry.sources.session import map_arrow
from quarry.sources.tables import cut

#: Hashed features of each of the four views: opening comments, whole text behind them, file name, folders.
BUCKETS, VIEWS = 1 << 16, 4
OPENING_GRAMS, TEXT_GRAMS, NAME_GRAMS = (6, 8), (4,), (3, 5)
#: The sample the classifier is fitted on: about LABELLED files get a label, those of least hash; of these about SAMPLE_MADE
#: machine-made ones, SAMPLE_ALIKE others whose opening speaks of such things, and SAMPLE_OTHER more are learnt from, none longer than SAMPLE_CHARS.
LABELLED, SAMPLE_MADE, SAMPLE_ALIKE, SAMPLE_OTHER, SAMPLE_CHARS = 24_000, 2000, 2000, 3000, 60_000
EPOCHS, RATE, PENALTY = 20, 0.5, 1e-5
#: The margin the machine is trained to: beyond it the score decides alone, within it a file is doubtful and its evidence is asked.
MARGIN = 1.0
#: Extensions of documents and settings, which are no source files.
NO_SOURCE = ["md", "markdown", "rst", "txt", "adoc", "yml", "yaml", "toml", "ini", "cfg", "conf", "properties", "json", "xml", "csv", "tsv", "lock"]

_GENERATED = re.compile(
    r"\bcode generated by\b|@generated\b|\bauto-?generated (?:from|by|file)\b|\bautogenerated\b|\bautomatically (?:created|generated|built|produced) (?:by|from|with)\b|\bthis file (?:was|is) (?:auto|generated)"
    r"|\bdo not (?:edit|modify)(?: by hand| this file| directly)?\s*[.!)]*\s*$|\bmanual changes will be (?:lost|overwritten)\b|\bproduced by \S+ v?\d|\bedit the [^,;\n]*,? not th(?:is|e) (?:output|file|result)\b|\bgenerated (?:by|from|with) (?:the )?\S+ ?(?:v?\d|compiler|generator|protoc)",
    re.I | re.M,
)
_VENDORED = re.compile(
    r"\bvendored from \S+ v?\d|\bcopy of \S+ was (?:imported|taken|copied|vendored) from\b|\bsend fixes upstream\b|\blocal patches are listed\b|\bcopyright \(c\)[^\n]*\n(?:[^\w\n]*\n)*[^\w\n]*(?:released|licensed|distributed) under\b"
    r"|@package \S+[^\n]*\n(?:[^\n]*\n){0,3}[^\n]*@license\b|\bbundled with \S+(?: \S+)? for offline use\b",
    re.I,
)
_FOREIGN = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendors?|third[_-]?party|3rd_?party|_vendor|jspm_packages|pods|site-packages)/(?!$)|(?:^|/)(?:external|extern|deps)/[^/]+-\d+(?:\.\d+)+/", re.I)
_MADE = re.compile(r"(?:^|/)(?:generated|__generated__|autogen|codegen|_generated|gen)/(?!$)", re.I)
_MADE_NAME = re.compile(r"(?:_pb2(?:_grpc)?|\.pb|\.gen|\.generated|\.g|_generated)\.\w+$", re.I)
_SMALL_NAME = re.compile(r"(?:[.-]min|\.bundle|\.chunk)\.\w+$", re.I)
_GIVEAWAYS = re.compile(
    r"^[^\n]*(?:generat|do not (?:edit|modify)|automatically|manual changes|produced by|vendored|upstream|copyright|licen[sc]e|bundled with|local patches|not this (?:output|file)|by hand|@package|@version)[^\n]*$",
    re.I | re.M,
)
_COMMENT = re.compile(r"^\s*(?://|\#|/?\*|<!--|\"\"\"|\'\'\')")
_OPENING = re.compile(
    r"(?:\s*(?:<\?php\b|//[^\n]*|\#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|[rRuU]?\"{3}[\s\S]*?(?:\"{3}|\Z)|[rRuU]?'{3}[\s\S]*?(?:'{3}|\Z)|declare\s*\([^)\n]*\)\s*;|(['\"])use strict\1;?))*"
)
_STATEMENT = re.compile(r"\b(?:function|def|class|return|if|for|while|foreach|throw|raise|import|require_once|use|namespace|switch|const \w+ = \(|async)\b|=>\s*\{")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\d+(?:\.\d+)?(?:e[+-]?\d+)?|\b0x[0-9a-f]+\b", re.I)
_TABLE = re.compile(r"^\s*(?:if \(?\$?[\w.]+\[\$?[\w.]+ \+ \d+\] ===? \d+\)?:? ?\{? ?return|case \d+:\s*return)\b", re.M)


def header(text: str) -> str:
    """The comments (and the docstring) a file opens with, however many lines they have: all that stands before its first statement."""
    return _OPENING.match(text.removeprefix("\ufeff")).group()


def shape(text: str) -> str | None:
    """minified, data or generated (a decoding table), by the whole text alone; None for what reads like written code."""
    lines = [x for x in text.split("\n") if x.strip() and not _COMMENT.match(x)]
    if not lines:
        return None
    code = sum(map(len, lines))
    literal = sum(len(m.group()) for m in _LITERAL.finditer(text))
    words = len(_STATEMENT.findall(_LITERAL.sub("", text)))
    if code > 200 and literal > 0.5 * len(text) and words <= 2 or code > 400 and literal > 0.85 * len(text):
        return "data"
    if len(_TABLE.findall(text)) >= 8:
        return "generated"
    dense = sum(len(x) for x in lines if len(x) > 250 and x.count(" ") < len(x) / 6 and len(re.findall(r"[;{}]", x)) > len(x) / 80)
    return "minified" if dense > 0.6 * code else None


def evidence(path: str, text: str) -> str | None:
    """generated, minified, vendored or data, if the file shows what only such files have; None otherwise.

    A word in a comment or a folder that merely contains such a word is none: phrases must be statements about the
    file in its opening comments, folders whole path components. It labels the sample and is asked about doubtful files."""
    head = header(text)
    if _VENDORED.search(head) or _FOREIGN.search(path):
        return "vendored"
    if _GENERATED.search(head) or _MADE.search(path) or _MADE_NAME.search(path):
        return "generated"
    found = shape(text)
    return found or ("minified" if _SMALL_NAME.search(path) else None)


def mask(text: str) -> str:
    """The text without the lines of its opening comments that give its origin away."""
    text = text.removeprefix("\ufeff")
    head = header(text)
    return _GIVEAWAYS.sub("", head) + text[len(head) :]


_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def _grams(text: str, view: int, sizes: tuple[int, ...]) -> np.ndarray:
    """The buckets of the distinct character n-grams of a text, n at most 8; letter case and which digit it is do not count."""
    b = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    found = [np.empty(0, dtype=np.int64)]
    for n in sizes:
        if len(b) >= n:
            x = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                x |= b[i : len(b) - n + 1 + i] << np.uint64(8 * i)
            found.append((mix(np.unique(x) + np.uint64(n * 7919 + view * 104729)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.unique(np.concatenate(found)) + view * BUCKETS


def features(path: str, text: str) -> np.ndarray:
    """The features of a file, ascending: n-grams of its opening comments, of the text behind them and of its name, and its folders whole."""
    text = text.removeprefix("\ufeff")
    head = header(text)
    steps = [re.sub(r"\d+", "0", c.lower()) for c in path.split("/")]
    folders = np.array([hash_name(f"/{c}/") for c in steps[:-1]] or [hash_name("//")], dtype=np.uint64)
    named = np.unique((mix(folders) % np.uint64(BUCKETS)).astype(np.int64)) + 3 * BUCKETS
    opening = re.sub(r"[ \t]+", " ", head)
    return np.concatenate((_grams(opening, 0, OPENING_GRAMS), _grams(text[len(head) :], 1, TEXT_GRAMS), _grams(f"/{steps[-1]}/", 2, NAME_GRAMS), named)).astype(np.int32)


def values(f: np.ndarray) -> np.ndarray:
    """The value of each feature: every view that has any is a vector of length 1."""
    view = f // BUCKETS
    return 1 / np.sqrt(np.bincount(view, minlength=VIEWS)[view])


def hash_name(name: str) -> int:
    h = 0xCBF29CE484222325
    for b in name.encode("utf-8", "replace"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def of(self, f: np.ndarray) -> float:
        return float(self.weights[f] @ values(f)) + self.bias

    def score(self, path: str, text: str) -> float:
        return self.of(features(path, text))


def fit_svm(rows: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
    """A linear support-vector machine: hinge loss with squared penalty, averaged stochastic subgradients, the labels weighed alike."""
    w, total, bias, bias_total, steps = np.zeros(VIEWS * BUCKETS), np.zeros(VIEWS * BUCKETS), 0.0, 0.0, 0
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for k in rng.permutation(len(y)):
            i, v = rows[k], values(rows[k])
            if y[k] * (w[i] @ v + bias) < 1:
                w[i] += rate * weight[k] * y[k] * v
                bias += rate * weight[k] * y[k] * 0.1
        w *= 1 - PENALTY * len(y) * rate
        if epoch >= EPOCHS // 2:
            total += w
            bias_total += bias
            steps += 1
    return Model(total / steps, bias_total / steps)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repo, path and label (made by evidence; alike: other, but its opening speaks of it; other); blank files and those too long for the sample are left out."""
    for batch in batches:
        out = []
        for repo, path, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = assemble(parts)
            if text.strip() and len(text) <= SAMPLE_CHARS:
                out.append((repo, path, "made" if evidence(path or "", text) else "alike" if _GIVEAWAYS.search(header(text)) else "other"))
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["repo", "file_path", "label"])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo, file_path, made, whole, masked, still): the features of a file as it is and, where that is another text, masked, and whether it then still has evidence."""
    for batch in batches:
        repos, paths, parts, made = (c.to_pylist() for c in batch.columns)
        whole, masked, still = [], [], []
        for path, p, m in zip(paths, parts, made, strict=True):
            path, text = path or "", assemble(p)
            other = mask(text)
            whole.append(features(path, text).tobytes())
            masked.append(features(path, other).tobytes() if other != text.removeprefix("\ufeff") else None)
            still.append(bool(m) and evidence(path, other) is not None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(whole, pa.binary()), pa.array(masked, pa.binary()), pa.array(still, pa.bool_())], names=["repo", "file_path", "made", "whole", "masked", "still"]
        )


def source_files(chunks: DataFrame) -> DataFrame:
    """(repo, file_path, parts) of all files but documents and settings."""
    kind = F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1))
    return file_parts(chunks.where(F.col("file_path").isNull() | ~kind.isin(NO_SOURCE)))


def labelled(files: DataFrame) -> list:
    """The rows of _learnt for the bounded sample.

    About LABELLED files, those of least hash, are labelled by their evidence and thinned again by hash to the numbers
    wanted of either label; only their hashed features (a few thousand integers a file) come to the driver."""
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "repo", "file_path"), F.lit(1 << 31))
    every = files.count()
    marked = cut(map_arrow(files.where(place("label") < min(1.0, LABELLED / max(1, every)) * (1 << 31)).select("repo", "file_path", "parts"), _label, "repo string, file_path string, label string"))
    counted = dict(marked.groupBy("label").count().collect())
    share = F.lit(0.0)
    for label, wanted in (("made", SAMPLE_MADE), ("alike", SAMPLE_ALIKE), ("other", SAMPLE_OTHER)):
        share = F.when(F.col("label") == label, wanted / max(wanted, counted.get(label, 0))).otherwise(share)
    chosen = marked.where(place("learn") < share * (1 << 31)).withColumn("made", F.col("label") == "made")
    f, c = files.alias("f"), F.broadcast(chosen).alias("c")
    rows = f.join(c, F.col("f.repo").eqNullSafe(F.col("c.repo")) & F.col("f.file_path").eqNullSafe(F.col("c.file_path"))).select("f.repo", "f.file_path", "f.parts", "c.made")
    out = map_arrow(rows, _learnt, "repo string, file_path string, made boolean, whole binary, masked binary, still boolean").collect()
    return sorted(out, key=lambda r: (r["repo"] or "", r["file_path"] or ""))


def _fit(rows: list) -> Model | None:
    """The model of these rows: each file as it is, and, where path or body still tell it, once more with the giveaways of its opening masked."""
    x, y = [], []
    for r in rows:
        x.append(np.frombuffer(r["whole"], np.int32))
        y.append(int(r["made"]))
        if r["masked"] is not None and (r["still"] or not r["made"]):
            x.append(np.frombuffer(r["masked"], np.int32))
            y.append(int(r["made"]))
    return fit_svm(x, y) if len(set(y)) == 2 else None


def train(files: DataFrame) -> tuple[Model, dict[str, float]]:
    """The model, fitted on the whole sample, and the figures of one fitted without the repositories held out.

    Repositories whose name hashes to the fourth quarter are held out. Figures: of files as they are by the sign of the
    score; of those whose opening was masked and whose path or body still tells; the share within the margin. With
    fewer than two labels in the sample every score is 0, so that every file is doubtful."""
    rows = labelled(files)
    last = [r for r in rows if hash_name(r["repo"] or "") >> 20 & 3 == 3]
    first = [r for r in rows if hash_name(r["repo"] or "") >> 20 & 3 != 3]
    figures = {"files": len(rows), "held_out": len(last)}
    if last and first and (m := _fit(first)):
        for name, part in (("whole", last), ("masked", [r for r in last if r["still"] or not r["made"]])):
            s = np.array([m.of(np.frombuffer(r[name] or r["whole"], np.int32)) for r in part])
            y = np.array([r["made"] for r in part], dtype=bool)
            figures |= {f"{name}_recall": (y & (s > 0)).sum() / max(1, y.sum()), f"{name}_precision": (y & (s > 0)).sum() / max(1, (s > 0).sum()), f"{name}_doubtful": (abs(s) < MARGIN).sum() / max(1, len(s))}
    return _fit(rows) or Model(np.zeros(VIEWS * BUCKETS), 0.0), figures


def classify(files: DataFrame, model: Model, check: bool = True) -> DataFrame:
    """(repo, file_path, score, checked): the files the classifier takes for machine-made.

    A score of MARGIN or more decides alone, as does one of -MARGIN or less; in between a file is doubtful and counts
    if its evidence, checked exactly, says so. Without `check` the sign of the score decides there too."""
    shared = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for repo, path, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = assemble(parts)
                if not text.strip():
                    continue
                s = m.score(path or "", text)
                doubtful = check and abs(s) < MARGIN
                if evidence(path or "", text) is not None if doubtful else s > 0:
                    out.append((repo, path, s, doubtful))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["repo", "file_path", "score", "checked"])

    return map_arrow(files.select("repo", "file_path", "parts"), run, "repo string, file_path string, score double, checked boolean")


def machine_made(chunks: DataFrame, check: bool = True) -> DataFrame:
    """(repo, file_path, score, checked) of the files that are generated, minified, vendored or data saved as code.

    The files are put together once and written to the shared folder; the model (VIEWS times BUCKETS weights,
    whatever the data) and the keys of the sample are all that is broadcast, the features of the bounded sample all
    that is collected. Blank files, documents and settings are no cases; null paths and contents count as empty."""
    files = cut(source_files(chunks))
    model, _ = train(files)
    return classify(files, model, check)
