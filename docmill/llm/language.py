"""Problem 3: the language of each text and of each foreign stretch within one.

One character model per language, interpolated Kneser-Ney up to order 5, held as
sorted arrays of n-gram hashes that are searched for whole batches of words at
once. A stretch gets the language of least cross-entropy per character; it is
rejected where even the best model finds it stranger than nearly all of its own
held-out sentences. Within a text a Viterbi pass over the words allows changes of
language, at a price that is low between sentences and high within one.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.seeds import SEEDS
from docmill.scratch import stage

LANGUAGES = tuple(sorted(SEEDS))
ORDER = 5
#: Bound of the sample that the models are retrained on: characters of different sentences of labelled rows, for each label.
SAMPLE_CHARS = 300_000
#: Pieces that texts are sampled in: sentences, or the parts of longer ones.
_PIECE = r"[^.!?\n]{1,1000}[.!?]*"
#: Price, in nats, of a change of language at the end of a sentence and elsewhere.
CHANGE_AT_END, CHANGE_INSIDE = 4.0, 18.0
#: A foreign stretch counts as a sentence from this many words and letters; a whole record is judged from fewer.
LEAST_WORDS, LEAST_LETTERS, LEAST_CONFIDENCE = 6, 24, 0.9

#: Highest cross-entropy per character, in nats, where too little was held out to set it.
UNTRIED_LIMIT = 4.5

# Names that labels give the languages (ISO 639 codes, English and own names).
LABELS = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "inglese", "inglês", "engels"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "francese", "francês", "frans"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "tedesco", "alemão", "duits"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "spagnolo", "espanhol", "spaans"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch", "italiaans"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "portugués", "portoghese", "portugees"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "néerlandais", "niederländisch", "holandés", "olandese", "holandês"),
}
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_END = regex.compile(r"[.!?…;:|/•]|\n\s*\n|\n\s*[-*•#|]")


def declared(label):
    """Two-letter code of a label in any notation, null where it names none of the languages."""
    low = F.regexp_replace(F.lower(F.trim(label)), r"[-_ (].*$", "")
    out = F.when(F.lit(False), "")
    for code, names in LABELS.items():
        out = out.when(low.isin(*names), code)
    return out


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each place; places before k - 1 hold no n-gram."""
    h = np.full(len(codes), np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k - 1, -1, -1):
            shifted = np.zeros(len(codes), np.uint64)
            if j < len(codes):
                shifted[j:] = codes[: len(codes) - j]
            h = h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
            h ^= h >> np.uint64(29)
    return h


@dataclass
class CharModel:
    """Sorted hashes with, per order, the discounted share of each n-gram and the back-off weight of each context."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: float = 1e-4

    @classmethod
    def train(cls, words: dict[str, int]) -> CharModel:
        """From counted words; n-grams don't cross words."""
        self = cls()
        texts = sorted(words)
        weight = np.array([words[w] for w in texts], np.float64)
        codes, start, size = _lay(texts)
        per = np.repeat(weight, size)
        place = np.arange(len(codes)) - np.repeat(start, size)
        higher = None
        levels = []
        for k in range(ORDER, 0, -1):
            ok = place >= max(k - 1, 1)
            h, ctx = _hashes(codes, k)[ok], np.roll(_hashes(codes, k - 1), 1)[ok] if k > 1 else np.zeros(int(ok.sum()), np.uint64)
            keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
            count = np.bincount(inv, weights=per[ok])
            if higher is not None:  # below the top: in how many different contexts the n-gram was seen
                seen_in = np.bincount(np.searchsorted(keys, higher), minlength=len(keys)).astype(np.float64)
                # n-grams at the start of a word have no longer one and keep their count
                count = np.where(place[ok][first] == k - 1, count, np.maximum(seen_in, 1.0))
            ctx_of = ctx[first]
            levels.append((k, keys, count, ctx_of))
            if k > 1:  # the distinct n-grams of this order and their tails one shorter
                tail = _hashes(codes, k - 1)[ok]
                higher = tail[first]
        for k, keys, count, ctx_of in reversed(levels):
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            cs, ci = np.unique(ctx_of, return_inverse=True)
            total = np.bincount(ci, weights=count)
            kinds = np.bincount(ci)
            self.grams.append((keys, ((count - min(d, 0.9)) / total[ci]).astype(np.float32)))
            self.contexts.append((cs, (min(d, 0.9) * kinds / total).astype(np.float32)))
        return self

    def log_probs(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), self.floor)
        for k in range(1, ORDER + 1):
            keys, share = self.grams[k - 1]
            cs, back = self.contexts[k - 1]
            ok = place >= max(k - 1, 1)
            h = _hashes(codes, k)
            c = np.roll(_hashes(codes, k - 1), 1) if k > 1 else np.zeros(len(codes), np.uint64)
            a = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            b = np.minimum(np.searchsorted(cs, c), len(cs) - 1)
            own = np.where(keys[a] == h, share[a], 0.0)
            lam = np.where(cs[b] == c, back[b], 1.0)
            p = np.where(ok, own + lam * p, p)
        return np.log(np.maximum(p, 1e-9))


def _lay(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each between blanks, one after the other."""
    joined = "".join(f" {w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    return codes, np.cumsum(size) - size, size


@dataclass
class Identifier:
    models: dict[str, CharModel]
    temperature: float = 1.0
    limit: dict[str, float] = field(default_factory=dict)  # highest cross-entropy per character that is accepted
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            if len(self.memo) > 300_000:
                self.memo.clear()
                new = list(dict.fromkeys(words))
            codes, start, size = _lay(new)
            place = np.arange(len(codes)) - np.repeat(start, size)
            table = np.stack([np.add.reduceat(np.where(place > 0, self.models[x].log_probs(codes, place), 0.0), start) for x in LANGUAGES], axis=1)
            for w, row in zip(new, table):
                self.memo[w] = row
        return np.stack([self.memo[w] for w in words]) if words else np.zeros((0, len(LANGUAGES)))

    def segments(self, text: str) -> list[tuple[int, int, str, float, int, bool]]:
        """(start, end, language, confidence, words, whole) of the stretches of a text, in order."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int, bool]]]:
        spans: list[list[tuple[int, int]]] = []
        words: list[str] = []
        ends: list[list[bool]] = []
        for t in texts:
            own = [m.span() for m in _WORD.finditer(t)]
            spans.append(own)
            words.extend(t[a:b].lower().replace("’", "'") for a, b in own)
            ends.append([bool(_END.search(t, own[i][1], own[i + 1][0])) for i in range(len(own) - 1)] + [True] if own else [])
        table = self.scores(words)
        out, at = [], 0
        for t, own, end in zip(texts, spans, ends):
            s = table[at : at + len(own)]
            at += len(own)
            out.append(self._cut(t, own, end, s) if len(own) else [])
        return out

    def _cut(self, text, own, end, s):
        n = len(own)
        total = s.sum(0)
        path = None
        end = np.array(end)
        # sentences that are all best explained by one language, without a better split inside, need no search
        c = np.vstack([np.zeros(s.shape[1]), np.cumsum(s, axis=0)])
        stops = np.flatnonzero(end) + 1
        starts = np.append(0, stops[:-1])
        whole = c[stops] - c[starts]
        first = np.repeat(c[starts], stops - starts, axis=0)
        last = np.repeat(c[stops], stops - starts, axis=0)
        two = (c[1:] - first).max(1) + (last - c[1:]).max(1)
        gain = np.maximum.reduceat(two, starts) - whole.max(1)
        best = int(total.argmax())
        if (gain < CHANGE_INSIDE).all() and (whole.max(1) - whole[:, best] < CHANGE_AT_END).all():
            path = np.full(n, best)
        else:
            score, back = s[0].copy(), np.zeros((n, s.shape[1]), np.int8)
            price = np.where(end, CHANGE_AT_END, CHANGE_INSIDE)
            for i in range(1, n):
                top = int(score.argmax())
                moved = score[top] - price[i - 1]
                stay = score >= moved
                back[i] = np.where(stay, np.arange(len(score)), top)
                score = np.where(stay, score, moved) + s[i]
            path = np.empty(n, np.int64)
            path[-1] = int(score.argmax())
            for i in range(n - 1, 0, -1):
                path[i - 1] = back[i][path[i]]
        cuts = np.flatnonzero(np.diff(path)) + 1
        result = []
        for a, b in zip(np.append(0, cuts), np.append(cuts, n)):
            part = s[a:b].sum(0)
            letters = sum(own[i][1] - own[i][0] + 1 for i in range(a, b))
            k = int(path[a])
            z = (part - part.max()) / self.temperature
            conf = float(np.exp(z[k]) / np.exp(z).sum())
            lang = LANGUAGES[k] if -part[k] / letters <= self.limit.get(LANGUAGES[k], 99.0) else "und"
            result.append((own[a][0], own[b - 1][1], lang, conf, int(b - a), a == 0 and b == n))
        return result


def sentences(text: str) -> list[str]:
    return [x.strip() for x in regex.split(r"(?<=[.!?])\s+|\n\s*\n|\s/\s", text.replace("\n", " ") if "\n\n" not in text else text) if x.strip()]


def _counted(texts: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in texts:
        low = t.lower().replace("’", "'")
        for form in {low, plain(low)}:
            for w in _WORD.findall(form):
                out[w] = out.get(w, 0) + 1
    return out


def train(samples: list[str]) -> Identifier:
    """Models from the seeds, retrained on those sentences of ``samples`` that the seeds recognise with a clear margin.

    Every fifth of these is held out, to set the temperature of the confidence
    and the cross-entropy above which a language is rejected.
    """
    first = Identifier({x: CharModel.train(_counted([SEEDS[x]])) for x in LANGUAGES})
    found: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    first.scores(sorted({w.lower().replace("’", "'") for t in samples for w in _WORD.findall(t)}))
    for t in samples:
        for s in sentences(t):
            words = [w.lower().replace("’", "'") for w in _WORD.findall(s)]
            if len(words) < 5:
                continue
            z = first.scores(words).sum(0)
            order = np.argsort(-z)
            if z[order[0]] - z[order[1]] > 8 + 0.4 * len(words):
                found[LANGUAGES[order[0]]].append(s)
    kept = {x: [s for i, s in enumerate(found[x]) if i % 5] for x in LANGUAGES}
    held = {x: [s for i, s in enumerate(found[x]) if i % 5 == 0] for x in LANGUAGES}
    counts = {}
    for x in LANGUAGES:
        own = _counted(kept[x])
        for w, n in _counted([SEEDS[x]] * 3).items():
            own[w] = own.get(w, 0) + n
        counts[x] = own
    final = Identifier({x: CharModel.train(counts[x]) for x in LANGUAGES})
    gaps = []
    final.scores(sorted({w.lower().replace("’", "'") for x in LANGUAGES for t in held[x] for w in _WORD.findall(t)}))
    for k, x in enumerate(LANGUAGES):
        costs = []
        for s in held[x] + sentences(SEEDS[x])[::3]:
            words = [w.lower().replace("’", "'") for w in _WORD.findall(s)]
            if not words:
                continue
            z = final.scores(words).sum(0)
            gaps.append(z - z[k])
            costs.append(-z[k] / sum(len(w) + 1 for w in words))
        limit = float(np.mean(costs) + 6 * np.std(costs) + 0.6)
        final.limit[x] = limit if len(held[x]) >= 30 else max(limit, UNTRIED_LIMIT)
    gaps = np.array(gaps)
    loss = {t: float(np.log(np.exp(gaps / t - (gaps / t).max(1, keepdims=True)).sum(1)).mean() + ((gaps / t).max(1)).mean()) for t in (1, 2, 3, 4, 6, 8)}
    final.temperature = min(loss, key=loss.get)
    return final


def labelled_pieces(labelled: DataFrame) -> DataFrame:
    """(piece) of ``labelled(text, label)``: different sentences of labelled texts, about SAMPLE_CHARS characters of each label.

    They are taken by a hash of the sentence, whatever it begins with and wherever
    it stands; a sentence that is repeated counts once.
    """
    rows = labelled.where("text is not null and label is not null")
    size = rows.groupBy("label").agg(F.sum(F.length("text")).alias("n")).collect()  # one row a language
    share = F.lit(0)
    for r in size:
        share = F.when(F.col("label") == r["label"], int(1e6 * min(1.0, SAMPLE_CHARS / max(1, r["n"])))).otherwise(share)
    pieces = rows.select("label", F.explode(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))).alias("piece"))
    return pieces.where(F.pmod(F.xxhash64("piece"), F.lit(1_000_000)) < share).select("piece").distinct()


def fit(labelled: DataFrame) -> Identifier:
    """Train on a bounded sample of ``labelled(text, label)``; labels may be wrong, the seeds decide what is learnt from.

    Null texts, labels that name no language and empty tables leave the models of the seeds.
    """
    got = labelled_pieces(labelled).toArrow().column(0).to_pylist()
    # in an order of its own, so that what is held out has nothing to do with how sentences begin
    return train(sorted(got, key=lambda x: (zlib.crc32(x.encode()), x)))


def identify(df: DataFrame, model: Identifier) -> DataFrame:
    """(record_id, segment, start, end, language, confidence, words, whole) of ``df(record_id, text)``.

    Null, empty and wordless texts have no row. ``language`` is 'und' where it is
    rejected. Offsets are in characters. Repeated rows are answered as often.
    """
    sc = df.sparkSession.sparkContext
    held = sc.broadcast(model)  # bounded by SAMPLE_CHARS

    def run(batches):
        m = held.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [
                    (i, k, *seg)
                    for i, segs in zip(part.column(0).to_pylist(), m.batch([x or "" for x in part.column(1).to_pylist()]))
                    for k, seg in enumerate(segs)
                ]
                cols = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["record_id", "segment", "start", "end", "language", "confidence", "words", "whole"])

    shape = "record_id string, segment int, start int, end int, language string, confidence double, words int, whole boolean"
    return df.select(F.col("record_id").cast("string").alias("record_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def records(extraction: DataFrame, queries: DataFrame, domains: DataFrame) -> DataFrame:
    """(record_id, text, declared): chunks with the label of their domain, and benchmark queries with their own."""
    labels = domains.groupBy(F.col("name").alias("domain_name")).agg(F.min(declared(F.col("language"))).alias("declared"))
    chunks = extraction.select(F.col("chunk_id").alias("record_id"), F.col("chunk_text").alias("text"), "domain_name").distinct()
    chunks = chunks.join(F.broadcast(labels), "domain_name", "left").select("record_id", "text", "declared")  # domain_configs is of fixed size
    own = queries.select(F.col("query_id").alias("record_id"), F.col("query").alias("text"), declared(F.col("language")).alias("declared")).distinct()
    return chunks.unionByName(own).where("record_id is not null and text is not null")


def is_sentence(words, letters, whole, confidence):
    """Enough to be a whole sentence or question in its language."""
    return (confidence >= LEAST_CONFIDENCE) & ((whole & (words >= 3)) | ((words >= LEAST_WORDS) & (letters >= LEAST_LETTERS)))


def undeclared(rows: DataFrame, model: Identifier) -> DataFrame:
    """(record_id, language): languages of whole sentences of a record that aren't its declared one."""
    found = identify(rows.select("record_id", "text"), model).where("language <> 'und'")
    found = found.where(is_sentence(F.col("words"), F.col("end") - F.col("start"), F.col("whole"), F.col("confidence"))).select("record_id", "language").distinct()
    said = rows.where("declared is not null").select("record_id", F.col("declared").alias("language")).distinct()
    return found.join(said, ["record_id", "language"], "left_anti")
