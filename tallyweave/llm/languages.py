"""Missing or wrong language labels, by error-correcting output codes.

Each language has a binary codeword; one linear classifier per bit, on hashed character 1- to 3-grams,
predicts the bit, and the language whose codeword loses least (exponential loss, bits weighted by how well
they are learnt) is taken. The loss gap to the next language gives the confidence and flags ambiguity.
Texts are cut to lines and sentences; each distinct sentence of a batch is decoded once.

The classifiers are fitted on the driver on a bounded sample (``SAMPLE_DOCS`` labelled documents in hash
order, at most ``SAMPLE_SENTENCES`` distinct sentences a language); sentences that a first, stiff fit assigns to
another language than their label are left out of the next, so wrong labels do little harm. All
documents are decoded whole, in one pass without a shuffle.

Defined results: NULL, empty or wordless texts have no language and give no row; lines without words have
none. A tie of line votes goes to the language with more letters. Ambiguous sentences take the language of
their line, ambiguous lines that of their document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import table

LANGUAGES = ("zh", "en", "ja", "ko", "de", "fr", "es", "it", "pt")
# How language labels name the languages (two- and three-letter codes, English and own names).
NOTATIONS = {
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 简体中文", "en": "en eng english", "ja": "ja jpn japanese 日本語", "ko": "ko kor korean 한국어",
    "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español", "it": "it ita italian italiano", "pt": "pt por portuguese português",
}
BITS, BUCKETS = 15, 1 << 13
SAMPLE_DOCS, SAMPLE_SENTENCES, SAMPLE_CHARS = 4000, 300, 8000  # documents and their first characters, sentences a language
MAJORITY = 1.5  # times the share of the next label
AMBIGUOUS = 0.05
SLICE = 500


def named(label: str | None) -> str | None:
    """The language that a label names in any usual notation."""
    key = (label or "").strip().casefold().replace("_", "-").split("-")[0].strip()
    return next((lang for lang, names in NOTATIONS.items() if key in names.split()), None) if key else None


def codewords(seed: int = 7, tries: int = 3000) -> np.ndarray:
    """Codewords of +-1, of many draws those with the greatest least distance, each bit splitting the languages."""
    rng, best, most = np.random.RandomState(seed), None, (-1, -1)
    for _ in range(tries):
        c = rng.choice([-1, 1], (len(LANGUAGES), BITS))
        if (np.abs(c.sum(0)) > 5).any():
            continue
        apart = np.sort([(c[i] != c[j]).sum() for i in range(len(c)) for j in range(i)])
        if (apart[0], apart[:5].sum()) > most:
            best, most = c, (apart[0], apart[:5].sum())
    return best.astype(np.float32)


# ---------------------------------------------------------------- sentences and features


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(document of each line, number of the line, line of each sentence, distinct sentences, which of them).

    Digits are left out: they tell no language.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lines = pc.split_pattern(texts, "\n")
    doc = pc.list_parent_indices(lines).to_numpy()
    first = np.searchsorted(doc, doc, side="left")
    no = np.arange(len(doc)) - first
    flat = pc.list_flatten(lines)
    flat = pc.replace_substring_regex(flat, r"[\p{N}]+", "0")
    flat = pc.replace_substring_regex(flat, r"([。！？])", "\\1\x01")
    flat = pc.replace_substring_regex(flat, r"([.!?]['\"»”)]?)\s+([\p{Lu}\p{Lt}\p{Lo}¿¡«„“\"]|0[0:.,/-]*\s?\p{Lo})", "\\1\x01\\2")
    parts = pc.split_pattern(flat, "\x01")
    line = pc.list_parent_indices(parts).to_numpy()
    coded = pc.dictionary_encode(pc.list_flatten(parts))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return doc, no, line, coded.dictionary, coded.indices.to_numpy()


_LETTER: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket numbers of all 1-, 2- and 3-grams, where each text begins, and its number of letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    joined = "  ".join(texts).lower() + "  "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], np.int64) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    codes = np.minimum(codes, 0xFFFF)
    letter = _LETTER[0][codes]
    c = np.where(letter, codes, 32).astype(np.uint64)
    one = np.append(c[1:], 32).astype(np.uint64)
    two = np.append(c[2:], [32, 32]).astype(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    mix = lambda x: ((x * m) >> np.uint64(51)).astype(np.int64)
    g1 = mix(c + np.uint64(1 << 20))
    g2 = mix(c * np.uint64(65599) + one + np.uint64(2 << 40))
    g3 = mix((c * np.uint64(65599) + one) * np.uint64(65599) + two + np.uint64(3 << 45))
    blank = ~letter
    g1[blank] = g2[blank & (one == 32)] = g3[blank & (one == 32)] = -1
    return [g1, g2, g3], starts, np.add.reduceat(letter.astype(np.int64), starts)


class Codes:
    """Bit classifiers with their codewords."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, bits: np.ndarray):
        self.table = np.vstack([weights, np.zeros((1, weights.shape[1]))]).astype(np.float32)  # the last row is no gram
        self.bias, self.bits, self.words = bias.astype(np.float32), bits.astype(np.float32), codewords()

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(predicted bits, letters) of each text."""
        ids, starts, letters = grams(texts)
        total = np.zeros((len(texts), self.table.shape[1]), np.float32)
        count = np.zeros(len(texts), np.int64)
        for g in ids:
            for a in range(0, len(starts), 256):  # small blocks stay in the cache
                lo, hi = starts[a], starts[a + 256] if a + 256 < len(starts) else len(g)
                total[a : a + 256] += np.add.reduceat(self.table[g[lo:hi]], starts[a : a + 256] - lo, axis=0)
            count += np.add.reduceat((g >= 0).astype(np.int64), starts)
        return total / np.maximum(count, 1)[:, None] + self.bias, letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, confidence): exponential loss of each codeword, bits weighted."""
        signed = margins[:, None, :] * self.words[None]
        loss = (np.exp(-2 * np.clip(signed, -3, 3)) * self.bits).sum(2)
        order = np.sort(loss, axis=1)
        return loss.argmin(1), 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9)


def fit(texts: list[str], labels: list[str]) -> Codes:
    """Least-squares bit classifiers on n-gram shares, fitted thrice; each time without the labels the fit before doubts."""
    words, y = codewords(), np.array([LANGUAGES.index(x) for x in labels])
    ids, starts, _ = grams(texts)
    x = np.zeros((len(texts), BUCKETS), np.float32)
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(ids[0]))))
    for g in ids:
        np.add.at(x, (row[g >= 0], g[g >= 0]), 1)
    x /= np.maximum(x.sum(1), 1)[:, None]
    keep = np.ones(len(texts), bool)
    for ridge in (0.3, 0.1, 0.02):
        a, t = x[keep], words[y[keep]]
        per = np.bincount(y[keep], minlength=len(LANGUAGES))
        w = (1 / np.maximum(per[y[keep]], 1)) ** 0.5
        w *= len(w) / w.sum()
        mean, target = (a * w[:, None]).mean(0), (t * w[:, None]).mean(0)
        centred = (a - mean) * np.sqrt(w)[:, None]
        k = centred @ centred.T
        k[np.diag_indices_from(k)] += ridge * np.trace(k) / len(k) + 1e-12
        weights = centred.T @ np.linalg.solve(k, (t - target) * np.sqrt(w)[:, None])
        bias = target - mean @ weights
        got = x @ weights + bias
        right = (np.sign(got[keep]) == t).mean(0)
        codes = Codes(weights, bias, np.clip(2 * right - 1, 0.05, 1))
        keep = (codes.decode(got)[0] == y) if ridge > 0.02 else keep
    return codes


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Distinct sentences and their labels of a bounded sample of labelled documents."""
    labels = {form: lang for lang, names in NOTATIONS.items() for form in names.split()}
    key = F.split(F.regexp_replace(F.lower(F.trim("lang")), "_", "-"), "-")[0]
    known = docs.filter(key.isin(list(labels)) & (F.length("text") > 0)).withColumn("lang", key)
    n_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a notation
    # the same number of documents of each notation, so that a rare language has its classifier; by a hash
    share = F.create_map(*[F.lit(x) for lang, n in n_of.items() for x in (lang, min(1.0, SAMPLE_DOCS / len(n_of) / n))]) if n_of else F.lit(0.0)
    rows = known.withColumn("h", F.xxhash64("doc_id")) if n_of else known.limit(0).withColumn("h", F.lit(0))
    rows = rows.filter(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) if n_of else rows
    rows = rows.select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "h").orderBy("h", "doc_id").limit(2 * SAMPLE_DOCS).collect()
    if not rows:
        return [], []
    doc, _, line, distinct, which = sentences(pa.array([r["text"] for r in rows], pa.string()))
    votes: dict[str, dict[str, int]] = {}
    for d, i in zip(doc[line], which):
        of = votes.setdefault(" ".join(distinct[int(i)].as_py().split()), {})
        lang = labels[rows[int(d)]["lang"]]
        of[lang] = of.get(lang, 0) + 1
    took = Counter(r["lang"] for r in rows)
    size, whole = Counter(), Counter()  # documents of each label: taken, and in all
    for form, n in took.items():
        size[labels[form]] += n
        whole[labels[form]] += n_of[form]
    ranked: dict[str, list[tuple[int, str]]] = {lang: [] for lang in LANGUAGES}
    for text, of in votes.items():
        # the labels are taken alike, so a common language has most of its documents under wrong ones: what counts is the share
        # of each label's documents, and in all documents no other label may have more
        share = {k: n / size[k] for k, n in of.items()}
        lang = max(share, key=lambda k: (share[k], k))
        next_ = max([0.0, *(x for k, x in share.items() if k != lang)])
        most = max(x * whole[k] for k, x in share.items())
        if sum(c.isalpha() for c in text) >= 6 and share[lang] >= MAJORITY * next_ and share[lang] * whole[lang] >= most:
            ranked[lang].append((of[lang], text))
    texts, langs = [], []
    for lang, found in ranked.items():
        found.sort(key=lambda x: (-x[0], x[1]))
        often = [x for x in found if x[0] > 2]  # a wrong label seldom meets the same sentence again
        for _, text in (often if len(often) >= 20 else found)[:SAMPLE_SENTENCES]:
            texts.append(text)
            langs.append(lang)
    return texts, langs


# ---------------------------------------------------------------- documents


def assign(texts: pa.Array, codes: Codes) -> tuple[list[tuple], list[tuple]]:
    """([(document, language, confidence, mixed)], [(document, line, languages, confidence, ambiguous)])."""
    doc, no, line, distinct, which = sentences(texts)
    words = distinct.to_pylist()
    lang, sure, letters = np.full(len(words), -1), np.zeros(len(words)), np.zeros(len(words), np.int64)
    has = np.array([any(c.isalpha() for c in w) for w in words], bool)
    at = np.flatnonzero(has)
    if len(at):
        margins, n = codes.margins([words[i] for i in at])
        lang[at], sure[at] = codes.decode(margins)
        letters[at] = n
        wide = np.array([sum(c > "\u2e80" for c in words[i]) for i in at])
        full = (n >= 10) | (wide >= 4)
        lang[at[~full & (sure[at] < 0.5)]] = -2  # words, but too few of them to tell
        lang[at[(sure[at] < AMBIGUOUS) & full]] = -2
    s_lang, s_sure, s_letters = lang[which], sure[which], letters[which]
    lines: dict[int, list] = {}
    for i, at_line in enumerate(line):
        if s_lang[i] != -1:
            lines.setdefault(int(at_line), []).append(i)
    by_doc: dict[int, list] = {}
    for at_line, parts in lines.items():
        by_doc.setdefault(int(doc[at_line]), []).append((int(no[at_line]), parts))
    docs, out, untold = [], [], []
    for d, its in sorted(by_doc.items()):
        votes, weight, rows = {}, {}, []
        for n, parts in sorted(its):
            told = [i for i in parts if s_lang[i] >= 0]
            seen = list(dict.fromkeys(int(s_lang[i]) for i in told))
            conf = float(np.average(s_sure[told], weights=s_letters[told] + 1)) if told else 0.0
            rows.append((n, seen, conf))
            for x in seen:
                votes[x] = votes.get(x, 0) + 1 / len(seen)
            for i in told:
                weight[int(s_lang[i])] = weight.get(int(s_lang[i]), 0) + int(s_letters[i])
        if not votes:  # no sentence tells enough, so the whole text is asked
            docs.append((d, None, 0.0, False))
            untold.append((len(docs) - 1, " ".join(words[int(i)] for _, parts in sorted(its) for i in which[parts]), [n for n, _ in sorted(its)]))
            continue
        main = max(votes, key=lambda x: (votes[x], weight[x], -x))
        mixed = len(votes) > 1
        docs.append((d, LANGUAGES[main], votes[main] / sum(votes.values()) * float(np.mean([c for _, s, c in rows if s])), mixed))
        out += [(d, n, "+".join(LANGUAGES[x] for x in (seen or [main])), conf, not seen or conf < AMBIGUOUS) for n, seen, conf in rows]
    if untold:
        best, conf = codes.decode(codes.margins([t for _, t, _ in untold])[0])
        for (at, _, numbers), x, c in zip(untold, best, conf):
            d, lang, low = docs[at][0], LANGUAGES[int(x)], min(float(c), AMBIGUOUS / 2)  # always ambiguous
            docs[at] = (d, lang, low, False)
            out += [(d, n, lang, low, True) for n in numbers]
    return docs, out


FOUND = "doc_id bigint, line_no int, lang string, confidence double, ambiguous boolean, kind string"


def _labelled(docs: DataFrame, codes: Codes) -> DataFrame:
    """A row for each document with words (line_no -1) and each of its lines with words."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                part = b.slice(a, SLICE)
                ids, labels = part.column(0).to_pylist(), part.column(2).to_pylist()
                found, lines = assign(part.column(1), model)
                mixed = {d for d, _, _, m in found if m}
                rows = [(ids[d], -1, lang, conf, conf < AMBIGUOUS, "document" if named(labels[d]) == lang else "relabelled") for d, lang, conf, _ in found if lang]
                rows += [(ids[d], n, lang, conf, amb, "mixed" if d in mixed else "line") for d, n, lang, conf, amb in lines]
                cols = list(zip(*rows)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select("doc_id", "text", "lang").filter(F.length("text") > 0).mapInArrow(run, FOUND)


def languages(docs: DataFrame) -> DataFrame:
    """Language, confidence and ambiguity of every document and every line with words."""
    texts, labels = training_sample(docs)
    if len(set(labels)) < 2:
        return docs.sparkSession.createDataFrame([], FOUND)
    return _labelled(docs, fit(texts, labels))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = languages(table(spark, sf_dir, "documents"))
    return rows.filter(F.col("kind").isin("relabelled", "mixed")).select("doc_id", "line_no", "lang")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "lang", "confidence", "ambiguous")
