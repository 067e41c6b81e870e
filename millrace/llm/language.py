"""Languages of documents and of their sentences by nearest TF-IDF centroid.

The model is fitted on labelled sentences: character n-grams within words, TF-IDF weighted and
normalised, and for each language several centroids found by clustering its sentences and shrunk
towards their mean.  A sentence
goes to the language of the centroid with the highest cosine; one that is far from every centroid is
rejected.  The dot products with the centroids are sums over words, so each word's share is worked
out once per worker and a sentence is a sum of table rows; its norm comes from a signed projection
of the same vectors.

One pass over the corpus, no shuffle; the broadcast model is bounded by the fitting sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.normalise import INVISIBLE
from millrace.session import spread

#: Bounds of the fitting sample, drawn by hash: labelled rows, labelled documents, sentences a language.
FIT_ROWS = 20_000
FIT_DOCUMENTS = 2_500
FIT_SENTENCES = 800
#: Sentences learnt of one document at most.
FIT_OF_ONE = 6
#: Longest labelled document that is drawn for fitting; longer ones are judged like all others.
FIT_CHARS = 100_000
#: Times that one mean a language is fitted to tell which labels hold.
MEANS = 2
CENTROIDS = 8
#: Weight of a language's mean in each of its centroids, beside 1 for the cluster's own.
SHRINK = 4.0
LONGEST_GRAM = 4
PROJECTION = 16
LEAST_WORDS = 8
#: A sentence below this cosine to every centroid has no language.
LEAST_COSINE = 0.09
#: Lead over the next language that a sentence needs to stand against the rest of its text.
LEAST_LEAD = 0.06
#: Confidence that such a sentence needs if its text is in neither of its likeliest languages.
LEAST_ODDS = 0.5
KEPT_WORDS = 200_000
#: A label that names a language: two letters, with a region after a dash or underscore.
LABEL = r"^([A-Za-z]{2})(?:[-_][A-Za-z0-9_-]+)?$"
SLICE_SENTENCES = 4_000


@lru_cache(maxsize=50_000)
def grams(word: str) -> Counter[str]:
    """Character n-grams of a lower-case word with its borders, and the word itself; not to be changed."""
    padded = f" {word} "
    found: Counter[str] = Counter()
    for size in range(2, LONGEST_GRAM + 1):
        for at in range(len(padded) - size + 1):
            found[padded[at : at + size]] += 1
    if len(padded) > LONGEST_GRAM:
        found[padded] += 1
    return found


_PLAIN_ACCENTS = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
_WORDS = re.compile(r"\b[^\W\d_]+\b")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class LanguageModel:
    """Centroids by language and, per worker, the vectors of the words met."""

    def __init__(self, languages: list[str], weights: dict[str, float], centroids: np.ndarray, of_language: np.ndarray, columns: dict[str, int]) -> None:
        self.languages, self.weights, self.centroids, self.of_language, self.columns = languages, weights, centroids, of_language, columns
        self.unseen = max(weights.values(), default=1.0)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, len(centroids) + PROJECTION), dtype=np.float32)

    def word_row(self, word: str) -> int:
        if len(self.rows) >= KEPT_WORDS:
            self.rows.clear()
        row = len(self.rows)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        found = grams(word[:40])
        weights = np.array([n * self.weights.get(g, self.unseen) for g, n in found.items()], dtype=np.float32)
        columns = np.array([self.columns.get(g, -1) for g in found], dtype=np.int64)
        known = columns >= 0
        out = np.concatenate([self.centroids[:, columns[known]] @ weights[known], weights @ _signs(list(found))])
        self.table[row] = out
        self.rows[word] = row
        return row

    def cosines(self, sentences: list[list[str]]) -> np.ndarray:
        """Cosine of each sentence (a list of at least one word) to the nearest centroid of each language."""
        if len(self.rows) + sum(map(len, sentences)) > KEPT_WORDS:
            self.rows.clear()
        known, add = self.rows.get, self.word_row
        flat = list(chain.from_iterable(sentences))
        ids = list(map(known, flat))
        if None in ids:
            for at, row in enumerate(ids):
                if row is None:
                    row = known(flat[at])
                    ids[at] = add(flat[at]) if row is None else row
        starts = np.zeros(len(sentences), dtype=np.int64)
        np.cumsum([len(s) for s in sentences[:-1]], out=starts[1:])
        sums = np.add.reduceat(self.table[np.array(ids, dtype=np.int64)], starts, axis=0)
        count = len(self.centroids)
        norms = np.sqrt((sums[:, count:] ** 2).sum(axis=1))
        cosines = sums[:, :count] / np.maximum(norms, 1e-9)[:, None]
        best = np.zeros((len(sentences), len(self.languages)), dtype=np.float32)
        for k in range(len(self.languages)):
            best[:, k] = cosines[:, self.of_language == k].max(axis=1)
        return best


@cache
def _sign_rows() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(8192, PROJECTION)) / np.float32(np.sqrt(PROJECTION))


def _signs(found: list[str]) -> np.ndarray:
    return _sign_rows()[[xxhash.xxh32_intdigest(g) % 8192 for g in found]]


def _clusters(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Normalised means of spherical k-means; fewer if some stay empty."""
    rng = np.random.default_rng(seed)
    count = min(count, len(points))
    centres = points[rng.choice(len(points), count, replace=False)]
    for _ in range(12 if count > 1 else 1):
        nearest = (points @ centres.T).argmax(axis=1)
        centres = np.stack([points[nearest == k].mean(axis=0) for k in range(len(centres)) if (nearest == k).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


class _Counted:
    """N-gram counts of (language, sentence) pairs, taken once for every fit on some of them.

    Each sentence is learnt as it is, and every third also without its accents.
    """

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.languages = sorted({language for language, _ in pairs})
        numbers: dict[str, int] = {}

        @lru_cache(maxsize=None)
        def of_word(word: str) -> np.ndarray:
            return np.array([numbers.setdefault(g, len(numbers)) for g, n in grams(word).items() for _ in range(n)], dtype=np.int64)

        #: Of each form: the pair it is of, its language, the numbers of its n-grams and their counts.
        self.forms: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for at, (language, text) in enumerate(pairs):
            low = text.lower()
            for form in dict.fromkeys((low, low.translate(_PLAIN_ACCENTS)) if at % 3 == 0 else (low,)):
                if words := words_of(form):
                    found, counts = np.unique(np.concatenate([of_word(w) for w in words]), return_counts=True)
                    self.forms.append((at, self.languages.index(language), found, counts))
        self.names = list(numbers)

    def fit(self, held: np.ndarray | None = None, centroids: int = CENTROIDS) -> LanguageModel:
        """A model of the pairs that ``held`` marks, or of all."""
        forms = [form for form in self.forms if held is None or held[form[0]]]
        documents = np.zeros(len(self.names), dtype=np.int64)
        for _, _, found, _ in forms:
            documents[found] += 1
        # N-grams of fewer than three sentences say nothing about a language.
        kept = np.nonzero(documents > 2)[0]
        place = np.full(len(self.names), -1)
        place[kept] = np.arange(len(kept))
        idf = (np.log((1 + len(forms)) / (1 + documents)) + 1).astype(np.float32)
        columns = {self.names[g]: k for k, g in enumerate(kept)}
        weights = {self.names[g]: float(idf[g]) for g in kept}
        centres, of_language = [], []
        for k in range(len(self.languages)):
            own = [(found, n) for _, language, found, n in forms if language == k] or [(kept[:0], kept[:0])]
            matrix = np.zeros((len(own), len(kept)), dtype=np.float32)
            for row, (found, n) in enumerate(own):
                inside = place[found] >= 0
                matrix[row, place[found[inside]]] = n[inside] * idf[found[inside]]
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
            # Centroids shrunk towards the mean of their language: one of a single phrase would attract that phrase's cognates.
            mean = matrix.mean(axis=0)
            clusters = _clusters(matrix, centroids, k) + SHRINK * mean / max(np.linalg.norm(mean), 1e-9)
            clusters /= np.maximum(np.linalg.norm(clusters, axis=1, keepdims=True), 1e-9)
            centres.append(clusters)
            of_language += [k] * len(clusters)
        stacked = np.concatenate(centres) if centres else np.zeros((0, len(kept)), dtype=np.float32)
        return LanguageModel(self.languages, weights, stacked, np.array(of_language, dtype=np.int64), columns)


def fit(samples: list[tuple[str, str]], centroids: int = CENTROIDS) -> LanguageModel:
    """A model of (language, sentence) pairs."""
    return _Counted(samples).fit(None, centroids)


def refit(samples: list[tuple[str, str]], documents: list[tuple[str, str]], most: int = FIT_SENTENCES) -> LanguageModel:
    """A model of the samples and of the sentences of (language, text) documents whose label holds.

    Wrong labels and foreign sentences are told by a model with one centroid a language, fitted on the
    samples and on the documents as they are labelled: a mean is hardly moved by the few that are
    wrong, and it knows the phrases of every language, which a model of the samples alone doesn't.
    Sentences that lead for another language in it are left out, the model is fitted again without
    them, and what holds then is learnt with all its centroids.
    """
    known = sorted({language for language, _ in samples})
    drawn: dict[str, dict[str, None]] = {language: {} for language in known}
    for language, text in documents:
        if language in known and len(drawn[language]) < 2 * most:
            parts = sorted((part for part, _ in sentences_of(text)), key=xxhash.xxh32_intdigest)
            drawn[language].update(dict.fromkeys(parts[:FIT_OF_ONE]))
    labelled = [(language, part) for language, parts in drawn.items() for part in parts]
    counted = _Counted([*samples, *labelled])
    held = np.ones(len(samples) + len(labelled), dtype=bool)
    if labelled:
        words = [words_of(part) for _, part in labelled]
        own = np.array([counted.languages.index(language) for language, _ in labelled])
        for _ in range(MEANS):
            cosines = counted.fit(held, 1).cosines(words)
            held[len(samples) :] = cosines.max(axis=1) <= cosines[np.arange(len(own)), own]
        for k in range(len(counted.languages)):
            held[len(samples) + np.nonzero((own == k) & held[len(samples) :])[0][most:]] = False
    return counted.fit(held)


def fit_model(samples: DataFrame, documents: DataFrame | None = None, rows: int = FIT_ROWS, texts: int = FIT_DOCUMENTS) -> LanguageModel:
    """Fit on labelled sentences and, if given, on a bounded draw of labelled documents.

    ``rows`` and ``texts`` bound what is drawn, by hash, from ``samples`` (language, sample) and
    ``documents`` (doc_id, text, lang); rows without label or text are left out.  The languages are those
    of the labelled sentences: without any, no text has a language.
    """
    wanted = samples.where("language is not null and sample is not null").select(F.lower(F.trim("language")).alias("l"), F.col("sample").alias("t")).distinct()
    picked = sorted((r["l"], r["t"]) for r in wanted.orderBy(F.xxhash64("t"), "l", "t").limit(rows).collect())
    if documents is None:
        return fit(picked)
    known = sorted({language for language, _ in picked})
    count = max(1, documents.count())
    # The draw is a hash range of the ids, so no sort and one scan; long texts take part whole.
    label = F.lower(F.regexp_extract("lang", LABEL, 1))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, texts / count))
    drawn = documents.where(share & F.col("text").isNotNull() & label.isin(known) & (F.length("text") <= FIT_CHARS)).select(label.alias("l"), "text", "doc_id").limit(2 * texts).collect()
    return refit(picked, [(r["l"], r["text"]) for r in sorted(drawn, key=lambda r: str(r["doc_id"]))])


_TAG = re.compile(r"<[/!?A-Za-z][^<>]{0,400}>")
_BRACKET = re.compile(r"\[[^\[\]\n]{0,60}\]|https?://\S+|\S*[@/\\=]\S*")
_QUOTE = re.compile(r"\([^()\n]{1,400}\)|«[^«»\n]{1,400}»|“[^“”\n]{1,400}”|„[^„“”\n]{1,400}[“”]|\"[^\"\n]{1,400}\"")
_MARK = re.compile(r"^(?:[-*•>]+|\d+[.)]|#+)?\s*")
_END = re.compile(r"[.!?…][\"'”»)*_]*\s+")
_NO_END = re.compile(r"(?:\b\d{1,4}|\b[^\W\d_]|\b(?:Dr|Mr|Mrs|Ms|Mme|Prof|Sr|Sra|St|No|Nr|bzw|ca|etc))$")
_CODE_MARKS = re.compile(r"[{}\[\]()=;<>|\\/_$#@^~`+*%]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
#: A line break inside a sentence: small letters or a number go on after a small letter or comma.
_WRAP = re.compile(r"(?<=[a-zà-ÿ,])\r?\n(?=[a-zà-ÿ\d])")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CODE_LINE = re.compile(r"^\s*(?:\$ |>>> |def |class |import |from \w+ import |return |for .+ in .+:|if .+:$|SELECT |INSERT |UPDATE |[{}|]|\[[{\"\[]|\w+\(.*\)$|\w+ = )")


def sentences_of(text: str) -> Iterator[tuple[str, list[str]]]:
    """Sentences of at least ``LEAST_WORDS`` words with their words.

    Code, markup, tables, headings and short quotes are left out; a quote as long as a sentence is
    one.  A line break ends a sentence unless the next line goes on in small letters or with a number.
    """
    text = _INVISIBLE.sub("", text)
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    for line in _WRAP.sub(" ", text).split("\n"):
        if len(line) < 2 * LEAST_WORDS:
            continue
        if _CODE_LINE.match(line) or line.lstrip().startswith("#"):
            continue
        line = _MARK.sub("", line.strip())
        if "[" in line or "@" in line or "/" in line or "=" in line:
            line = _BRACKET.sub(" ", line)
        if "(" in line or '"' in line or "«" in line or "“" in line or "„" in line:
            quotes = [q.group()[1:-1] for q in _QUOTE.finditer(line)]
            line = _QUOTE.sub(" ", line)
        else:
            quotes = []
        start = 0
        for end in _END.finditer(line):
            # No end after an ordinal, an initial or a short form.
            if line[end.start()] == "." and _NO_END.search(line, max(start, end.start() - 6), end.start()):
                continue
            if end.start() - start > 2 * LEAST_WORDS:
                quotes.append(line[start : end.start()])
            start = end.end()
        quotes.append(line[start:])
        for part in quotes:
            if len(part) < 2 * LEAST_WORDS:
                continue
            words = words_of(part)
            # An elided word and the next are one here.
            if len(words) - part.count("'") - part.count("’") < LEAST_WORDS or len(_CODE_MARKS.findall(part)) > 0.04 * len(part):
                continue
            yield part, words


def judge(model: LanguageModel, cosines: np.ndarray) -> list[tuple[int, float] | None]:
    """Language and confidence of each sentence of one text, or None.

    A sentence without a clear lead goes with the language that most of the text's clear sentences
    have, if that is its first or second choice; else it is rejected if it is less than even odds.
    """
    order = np.argsort(-cosines, axis=1)
    first, second = order[:, 0], order[:, 1] if cosines.shape[1] > 1 else order[:, 0]
    rows = np.arange(len(cosines))
    lead = cosines[rows, first] - (cosines[rows, second] if cosines.shape[1] > 1 else 0)
    clear = (lead >= LEAST_LEAD) & (cosines[rows, first] >= LEAST_COSINE)
    usual = np.bincount(first[clear], minlength=cosines.shape[1]).argmax() if clear.any() else -1
    shares = np.exp(cosines / 0.03)
    shares /= shares.sum(axis=1, keepdims=True)
    out: list[tuple[int, float] | None] = []
    for at in range(len(cosines)):
        pick = int(first[at])
        if cosines[at, pick] < LEAST_COSINE:
            out.append(None)
            continue
        if not clear[at] and usual >= 0:
            if usual in (first[at], second[at]):
                pick = int(usual)
            elif shares[at, pick] < LEAST_ODDS:
                out.append(None)
                continue
        out.append((pick, float(shares[at, pick])))
    return out


def _sliced(texts: list[str | None]) -> Iterator[tuple[int, int, list[list[tuple[str, list[str]]]]]]:
    """Runs of texts with at most about ``SLICE_SENTENCES`` sentences, so that long batches stay small."""
    start, held, count = 0, [], 0
    for at, text in enumerate(texts):
        found = list(sentences_of(text)) if text else []
        held.append(found)
        count += len(found)
        if count >= SLICE_SENTENCES:
            yield start, at + 1, held
            start, held, count = at + 1, [], 0
    if held:
        yield start, start + len(held), held


def _judged(model: LanguageModel, held: list[list[tuple[str, list[str]]]]) -> Iterator[list[tuple[int, float] | None]]:
    if not model.languages:
        yield from ([None] * len(found) for found in held)
        return
    flat = [words for found in held for _, words in found]
    cosines = model.cosines(flat) if flat else np.zeros((0, len(model.languages)), np.float32)
    at = 0
    for found in held:
        yield judge(model, cosines[at : at + len(found)]) if found else []
        at += len(found)


def document_languages(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """One row per document and language: id, label, language, confidence, sentences, n_languages.

    Confidence is the mean over the language's sentences.  A document without a sentence of a known
    language has no row.
    """
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            rows: list[tuple[str, float, int, int]] = []
            for start, _, held in _sliced(batch.column(2).to_pylist()):
                for offset, verdicts in enumerate(_judged(model, held)):
                    by: dict[int, list[float]] = {}
                    for verdict in verdicts:
                        if verdict:
                            by.setdefault(verdict[0], []).append(verdict[1])
                    for language, sure in by.items():
                        owners.append(start + offset)
                        rows.append((model.languages[language], sum(sure) / len(sure), len(sure), len(by)))
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                names=[id_column, "label", "language", "confidence", "sentences", "n_languages"],
            )

    narrow = documents.select(id_column, F.col(label_column).cast("string").alias("label"), text_column)
    return spread(narrow).mapInArrow(run, f"`{id_column}` {id_type}, label string, language string, confidence double, sentences int, n_languages int")


def segments(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of sentences of one language in order: id, segment, language, confidence, sentences, text."""
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            rows: list[tuple[int, str, float, int, str]] = []
            for start, _, held in _sliced(batch.column(1).to_pylist()):
                for offset, verdicts in enumerate(_judged(model, held)):
                    runs: list[tuple[int, list[float], list[str]]] = []
                    for (part, _), verdict in zip(held[offset], verdicts, strict=True):
                        if not verdict:
                            continue
                        if not runs or runs[-1][0] != verdict[0]:
                            runs.append((verdict[0], [], []))
                        runs[-1][1].append(verdict[1])
                        runs[-1][2].append(part.strip())
                    for number, (language, sure, parts) in enumerate(runs):
                        owners.append(start + offset)
                        rows.append((number, model.languages[language], sum(sure) / len(sure), len(sure), " ".join(parts)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *arrays], names=[id_column, "segment", "language", "confidence", "sentences", "text"])

    return spread(documents.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {id_type}, segment int, language string, confidence double, sentences int, text string")


def wrong_labels(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """doc_id, language of each document with several languages or a label that doesn't name its one.

    A label names a language if it is a two-letter code in any case, with a region after ``-`` or ``_``.
    """
    found = document_languages(documents, model, id_column, text_column, label_column)
    named = F.lower(F.regexp_extract(F.coalesce("label", F.lit("")), LABEL, 1))
    return found.where((F.col("n_languages") > 1) | (named != F.col("language"))).select(id_column, "language").distinct()


def model_for(spark: SparkSession, folder: str) -> LanguageModel:
    """The model of a folder's language_samples and documents."""
    return fit_model(spark.read.parquet(f"{folder}/language_samples.parquet"), spark.read.parquet(f"{folder}/documents.parquet"))
