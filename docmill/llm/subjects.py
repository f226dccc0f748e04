"""Problem 10: the subjects of each document, by classifier chains over its sentences and table rows.

A document is cut into units: sentences, list items and table rows. Term weights
per subject are learnt from labelled documents by expectation maximisation over
their units, so that a term gets its subject from the company it keeps, in any
language. On top stands a chain of logistic classifiers, one a subject, over term
scores, source and structure, each seeing the decisions before it, so that
subjects that occur together support each other. A beam search over the chain
gives the most probable combination for each unit, with calibrated probabilities;
a document is about the subjects of at least a fifth of its units. Only labelled
documents are learnt from, up to a bound; they are cut and counted on the cluster.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.language import LANGUAGES, CharModel, Identifier, _counted
from docmill.llm.seeds import SEEDS
from docmill.scratch import stage

#: Bounds of the sample of labelled documents that the classifier is fitted on: documents (by hash of the id), and characters.
LABELLED_ROWS, LABELLED_CHARS = 10_000, 30_000_000
MOST_SUBJECTS = 1_000
LEAST_SHARE = 0.2
EM_ROUNDS = 12
BEAM = 4
#: A term speaks for a subject from this share of its occurrences, and this many.
LEAST_PURITY, LEAST_COUNT = 0.6, 3
#: Where the weight of a term score may change, so that the chain can learn how much is enough.
BENDS = (0.25, 0.75, 1.25, 1.75)
CHAIN_ROUNDS = 5
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]+")
_LONG = re.compile(r"[^\W\d_]{3,}")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*\s+")
_LAST = re.compile(r"[.!?…][\"'”’»)\]]*$")
N_OWN = 7 + len(BENDS)
_RULE = regex.compile(r"\|?[\s:|\-=]+\|?")
_MARKER = regex.compile(r"^\s*(?:[-*•>]\s+|\d+[.)]\s+|[QAFRPD]\s?:\s+)")


def units(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each sentence, list item and table row; kind is 's', 'i', 'r' or 'h' (headings, which aren't counted)."""
    out: list[tuple[str, str]] = []
    held = ""

    def flush() -> None:
        nonlocal held
        whole, at = held.strip(), 0
        for m in _STOP.finditer(whole):
            if _WORD.search(whole, at, m.end()):
                out.append(("s", whole[at : m.end()].rstrip()))
            at = m.end()
        if _WORD.search(whole, at):
            out.append(("s", whole[at:]))
        held = ""

    lines = text.split("\n")
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            flush()
        elif s.startswith("#"):
            flush()
            out.append(("h", s.lstrip("# ")))
        elif s.startswith("|"):
            flush()
            if _RULE.fullmatch(s):
                # the row above a rule names the columns
                if out and out[-1][0] == "r":
                    out.pop()
            elif _WORD.search(s):
                out.append(("r", s))
        elif _MARKER.match(s) or "-->" in s:
            flush()
            body = _MARKER.sub("", s)
            parts = [p for p in regex.split(r"(?<=[.!?…])\s+", body) if _WORD.search(p)]
            out.extend(("i", p) for p in parts)
        else:
            held = f"{held} {s}" if held else s
            if _LAST.search(s):
                flush()
    flush()
    return out


class _Plain(dict):
    """Characters without their accents, once these stand apart."""

    def __missing__(self, c: int) -> str | None:
        self[c] = x = None if unicodedata.combining(chr(c)) else chr(c)
        return x


_PLAIN = _Plain()


def terms(text: str) -> list[str]:
    """Words of three letters or more without case and accents, and pairs of neighbours."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFD", t).translate(_PLAIN)
    words = _LONG.findall(t)
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:]))]))


def source_kind(source: str | None) -> str:
    return (source or "").split("/")[0].lower()


@dataclass
class ChainModel:
    subjects: list[str]
    weights: dict[str, int]  # place of each telling term
    table: np.ndarray  # weights of these terms, per subject
    chain: np.ndarray  # per subject: bias and features
    order: list[int]
    temperature: float

    def features(self, scores: np.ndarray, kinds: list[str], source: str, doc: np.ndarray) -> np.ndarray:
        """Per unit: own scores, the document's mean scores, kind of unit, hashed source."""
        n = len(scores)
        kind = np.zeros((n, 2))
        kind[:, 0] = [k == "r" for k in kinds]
        kind[:, 1] = [k == "i" for k in kinds]
        src = np.zeros((n, 4))
        src[:, zlib.crc32(source.encode()) % 4] = 1
        return np.hstack([scores, np.broadcast_to(doc, scores.shape), kind, src])

    def score(self, texts: list[str]) -> np.ndarray:
        get, places, size = self.weights.get, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = [k for w in terms(t) if (k := get(w)) is not None]
            places += own
            size[i] = len(own)
        return self.summed(np.array(places, np.int64), size)

    def summed(self, places: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores of units of ``size`` telling terms each, which stand at ``places`` one after the other."""
        out = np.zeros((len(size), len(self.subjects)))
        some = size > 0
        if some.any():
            out[some] = np.add.reduceat(self.table[places], (np.cumsum(size) - size)[some], axis=0)
        return np.clip(out, -6, 12)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, probability) of the best combination of each unit, by beam search along the chain."""
        n, s = len(x), len(self.subjects)
        beam = np.zeros((n, 1, s))
        logp = np.zeros((n, 1))
        rows = np.arange(n)[:, None]
        for step, j in enumerate(self.order):
            z = _design(x[:, None, :], beam, j, s) @ self.chain[j] / self.temperature
            on, off = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            both = np.concatenate([logp + off, logp + on], axis=1)
            keep = np.argsort(-both, axis=1)[:, :BEAM]
            width = beam.shape[1]
            new = beam[rows, keep % width].copy()
            new[:, :, j] = keep >= width
            beam, logp = new, both[rows, keep]
        return beam[:, 0] > 0.5, np.exp(logp[:, 0])


def _design(x: np.ndarray, before: np.ndarray, j: int, s: int) -> np.ndarray:
    """Features of classifier j: bias, its scores and the best other score, structure, and the decisions so far."""
    own, doc = x[..., j : j + 1], x[..., s + j : s + j + 1]
    other = np.max(np.delete(x[..., :s], j, axis=-1), axis=-1, keepdims=True)
    row = x[..., 2 * s : 2 * s + 1]
    bends = [np.clip(own - at, 0, 0.5) for at in BENDS]
    parts = [np.ones_like(own), np.clip(own, -2, 0), np.clip(own, 0, 4), np.clip(other, -2, 4), np.clip(own - other, -4, 0), np.clip(doc, -2, 4), row * np.clip(own, 0, 1), *bends, x[..., 2 * s :]]
    wide = np.broadcast_to(np.concatenate(parts, axis=-1), (*before.shape[:-1], N_OWN + x.shape[-1] - 2 * s))
    return np.concatenate([wide, before], axis=-1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method with a ridge, from zero: from weights of full decisions its steps overshoot."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Learnt:
    """Documents to learn from, cut into units and these into numbered terms, one after the other."""

    flat: np.ndarray  # number of each term of each unit
    per_unit: np.ndarray  # terms of each unit
    unit_doc: np.ndarray  # document of each unit
    kinds: list[str]  # of each unit
    tongue: np.ndarray  # language of each document
    sources: list[str]
    votes: list[dict[str, float]]
    names: list[str] = field(default_factory=list)  # of each number


def _learn_terms(d: Learnt, prior: np.ndarray) -> np.ndarray:
    """Share of each subject in the occurrences of each term, then its number of occurrences.

    Expectation maximisation over units. A unit's terms are counted towards the
    subjects of the rest of its document, not towards what they say themselves,
    so a phrase of every document stays neutral however often it comes; and
    shares are compared with those of the unit's language, so that the common
    words of a language don't stand for the subject it is mostly used for.
    """
    s, n_terms = prior.shape[1], max(1, len(d.names))
    flat, per_unit, unit_doc, tongue = d.flat, d.per_unit, d.unit_doc, d.tongue
    if not len(flat):
        return np.zeros((n_terms, s + 1))
    full = per_unit > 0
    starts = (np.cumsum(per_unit) - per_unit)[full]
    owner = np.repeat(np.arange(len(per_unit)), per_unit)
    n_tongues = int(tongue.max()) + 1
    spoken = tongue[unit_doc]
    # a term belongs to the language it is mostly used in
    use = np.zeros((n_terms, n_tongues))
    for k in range(n_tongues):
        use[:, k] = np.bincount(flat, weights=(spoken[owner] == k).astype(float), minlength=n_terms)
    of = use.argmax(1)
    post = np.zeros((len(per_unit), s))
    share = np.zeros((n_terms, s))
    for k in range(EM_ROUNDS):
        rest = prior.copy()
        for j in range(s):
            rest[:, j] += np.bincount(unit_doc, weights=post[:, j], minlength=len(prior))
        rest = rest[unit_doc] - post
        total = rest.sum(1, keepdims=True)
        belief = rest / total
        told = np.clip((total[:, 0] - 0.5) / 2.0, 0, 1)  # how much is known of the rest of the document
        final = k == EM_ROUNDS - 1
        if final:  # the last count is of the units themselves, for the terms that tell something
            belief, told = post / np.maximum(post.sum(1, keepdims=True), 1e-9), np.minimum(1, post.sum(1))
        c, base = np.empty((n_terms, s)), np.zeros((n_tongues, s))
        for j in range(s):
            w = belief[:, j] * told
            c[:, j] = np.bincount(flat, weights=w[owner], minlength=n_terms)
            base[:, j] = np.bincount(spoken, weights=w, minlength=n_tongues)
        seen = c.sum(1, keepdims=True)
        if final:
            return np.hstack([np.where(telling[:, None], (c + 0.3 / s) / (seen + 0.3), 1 / s), seen])
        everywhere = base.sum(0) / max(1e-9, base.sum())
        base = (base + 5.0 * everywhere) / (base.sum(1, keepdims=True) + 5.0)
        share = (c + 2.0 * base[of]) / (seen + 2.0)
        ratio = np.log(share / base[of])
        # a term tells something if one subject stands out, by far or beyond chance
        beyond = ((share - base[of]) / np.sqrt(base[of])).max(1) * np.sqrt(seen[:, 0])
        best = ratio.max(1) / np.maximum(np.log(1 / base[of, ratio.argmax(1)]), 1e-9)  # of what is possible
        telling = (best > 0.65) | ((best > 0.34) & (beyond > 2.6))
        ratio = np.where(telling[:, None], ratio, 0.0)
        part = ratio / np.maximum(np.log(1 / base[of]), 1e-9)  # a subject that is common anyway can't be told by much
        z, said = np.zeros((len(per_unit), s)), np.zeros((len(per_unit), s))
        for j in range(s):
            z[full, j] = np.add.reduceat(ratio[flat, j], starts)
            said[full, j] = np.add.reduceat(part[flat, j], starts)
        clear = np.clip((said.max(1) - 0.25) / 0.7, 0, 1)
        new = np.exp(z - z.max(1, keepdims=True))
        new *= (clear / new.sum(1))[:, None]
        post = new if k == 0 else (post + new) / 2  # two readings of few documents may else alternate
    return share


@lru_cache(maxsize=1)
def _ears() -> Identifier:
    return Identifier({x: CharModel.train(_counted([SEEDS[x]])) for x in LANGUAGES})


def _cut(text: str) -> tuple[list[str], list[list[str]], int]:
    """(kind of each unit, its terms, language of the text)."""
    d = units(text)
    words = [w.lower() for w in _WORD.findall(text)]
    return [k for k, _ in d], [terms(t) for _, t in d], int(_ears().scores(words).sum(0).argmax()) if words else 0


def _numbered(kinds: list[list[str]], sizes: list[list[int]], words: pa.Array, tongue: list[int], sources: list[str], votes: list[dict[str, float]]) -> Learnt:
    """Terms that occur in LEAST_COUNT documents get numbers, others are left out."""
    coded = words.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.array([n for d in sizes for n in d], np.int64)
    unit_doc = np.repeat(np.arange(len(sizes)), [len(d) for d in sizes])
    owner = np.repeat(np.arange(len(size)), size)
    once = np.unique(unit_doc[owner] * max(1, len(names)) + code) % max(1, len(names)) if len(code) else code
    often = np.bincount(once, minlength=len(names)) >= LEAST_COUNT
    kept = often[code] if len(code) else np.zeros(0, bool)
    number = np.cumsum(often) - 1
    flat = number[code[kept]] if len(code) else code
    per_unit = np.bincount(owner[kept], minlength=len(size)) if len(code) else size
    return Learnt(flat, per_unit, unit_doc, [k for d in kinds for k in d], np.array(tongue, np.int64), sources, votes, [n for n, ok in zip(names, often) if ok])


def train(texts: list[str], sources: list[str], votes: list[dict[str, float]], subjects: list[str]) -> ChainModel:
    """Fit on documents with their votes per subject (empty for unlabelled ones)."""
    cut = [_cut(t) for t in texts]
    words = pa.array([w for _, d, _ in cut for u in d for w in u], pa.string())
    return learn(_numbered([k for k, _, _ in cut], [[len(u) for u in d] for _, d, _ in cut], words, [x for _, _, x in cut], sources, votes), subjects)


def learn(d: Learnt, subjects: list[str]) -> ChainModel:
    s = len(subjects)
    if not s:
        return ChainModel([], {}, np.zeros((0, 0)), np.zeros((0, N_OWN + 6)), [], 1.0)
    prior = np.full((len(d.votes), s), 0.5 / s)
    for i, v in enumerate(d.votes):
        for name, n in v.items():
            if name in subjects:
                prior[i, subjects.index(name)] += 2.0 * n
    learnt = _learn_terms(d, prior)
    p, total = learnt[:, :s], learnt[:, s]
    # common words of all subjects have no purity; rare ones no weight
    telling = np.flatnonzero((total >= LEAST_COUNT * 0.7) & (p.max(1) >= LEAST_PURITY))
    table = np.maximum(np.log(np.maximum(p[telling], 0.02) * s) / np.log(max(2, s)), -1.0)
    model = ChainModel(subjects, {d.names[k]: i for i, k in enumerate(telling)} if d.names else {}, table, np.zeros((s, 1)), list(range(s)), 1.0)
    place = np.full(max(1, len(d.names)), -1)
    place[telling] = np.arange(len(telling))
    return _learn_chain(model, d, place)


def _targets(p: np.ndarray, doc: np.ndarray, voted: np.ndarray) -> np.ndarray:
    """What each unit is about, by Bayes' rule from ``p`` and the votes on its document; a fifth of the units at least for each vote.

    Annotators miss subjects and pass over mere mentions, so a subject without a
    vote is less likely, but not ruled out.
    """
    has = voted > 0
    caught = (p * has).sum(0) / np.maximum(p.sum(0), 1e-9)  # of units about a subject, how many have its vote
    chance = ((1 - p) * has).sum(0) / np.maximum((1 - p).sum(0), 1e-9)  # and of the others
    yes = p * np.where(has, caught, 1 - caught)
    no = (1 - p) * np.where(has, chance, 1 - chance)
    y = yes / np.maximum(yes + no, 1e-12)
    n = np.bincount(doc)
    for j in range(p.shape[1]):
        order = np.lexsort((-p[:, j], doc))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        top = (place < np.ceil(LEAST_SHARE * n[doc])) & has[:, j]
        y[top, j] = np.maximum(y[top, j], voted[top, j])
    return y


def _learn_chain(model: ChainModel, d: Learnt, place: np.ndarray) -> ChainModel:
    """The chain of classifiers, from the annotators' labels; ``place`` is that of each term in the model's table.

    A label is of a document, so which of its units are meant is learnt by
    expectation maximisation over the votes (:func:`_targets`). Every fifth
    document is held out for the calibration.
    """
    s = len(model.subjects)
    at = place[d.flat] if len(d.flat) else d.flat
    owner = np.repeat(np.arange(len(d.per_unit)), d.per_unit)
    told_any = at >= 0
    score = model.summed(at[told_any], np.bincount(owner[told_any], minlength=len(d.per_unit)))
    body = np.array([k != "h" for k in d.kinds], bool)
    xs, docs, told = [], [], []
    ends = np.cumsum(np.bincount(d.unit_doc, minlength=len(d.votes)))
    for i, (v, hi) in enumerate(zip(d.votes, ends)):
        lo = ends[i - 1] if i else 0
        own = np.array([v.get(name, 0.0) for name in model.subjects])
        rows = np.flatnonzero(body[lo:hi]) + lo
        if not len(rows) or not own.any():
            continue
        sc = score[rows]
        xs.append(model.features(sc, [d.kinds[r] for r in rows], source_kind(d.sources[i]), sc.mean(0)))
        docs.append(np.full(len(rows), len(docs)))
        told.append(np.broadcast_to(own / own.max(), sc.shape))
    if not xs:
        model.chain = np.zeros((s, N_OWN + 6 + s))
        model.chain[:, 0], model.chain[:, 2] = -4.0, 3.0
        return model
    x, doc, voted = np.vstack(xs), np.concatenate(docs), np.vstack(told)
    # the same units without their words: nothing said is about nothing, whatever the document
    mute = x[::3].copy()
    mute[:, :s] = 0
    model.order = [int(j) for j in np.argsort(-voted.sum(0), kind="stable")]
    held = doc % 5 == 0 if len(docs) >= 10 else np.zeros(len(doc), bool)
    # at first, a unit shares in a subject by how its terms compare with those for the others
    rest = np.maximum(x[:, :s], 0)
    y = _targets(rest / np.maximum(rest.max(1, keepdims=True), 1.0), doc, voted)
    chain: list[np.ndarray | None] = [None] * s
    for _ in range(CHAIN_ROUNDS):
        before, p = np.zeros_like(y), np.zeros_like(y)
        for j in model.order:
            design = _design(x, before, j, s)
            silent = _design(mute, np.zeros((len(mute), s)), j, s)
            chain[j] = _logistic(np.vstack([design[~held], silent]), np.concatenate([y[~held, j], np.zeros(len(mute))]))
            p[:, j] = 1 / (1 + np.exp(-np.clip(design @ chain[j], -30, 30)))
            before[:, j] = y[:, j]
        y = _targets(p, doc, voted)
    model.chain = np.stack(chain)
    if not held.any():
        return model
    loss = {}
    for t in (0.5, 1.0, 1.5, 2.0, 3.0):
        done, total = np.zeros_like(y), 0.0
        for j in model.order:
            z = _design(x, done, j, s)[held] @ model.chain[j] / t
            total += (y[held, j] * np.logaddexp(0, -z) + (1 - y[held, j]) * np.logaddexp(0, z)).mean()
            done[:, j] = y[:, j]
        loss[t] = total
    model.temperature = min(loss, key=loss.get)
    return model


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> ChainModel:
    """Train on the labelled documents, up to LABELLED_ROWS of them and LABELLED_CHARS characters, taken by hash of the id."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"a chain is meant for {MOST_SUBJECTS} subjects at most")
    votes = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject", "annotator").distinct()
    votes = votes.groupBy("doc_id", "subject").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("subject", "n")).alias("v"))
    texts = documents.where("text is not null").select("doc_id", "text", "source")
    # of repeated ids one row counts
    known = texts.join(votes, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("d"), F.first("v").alias("v"))
    known = stage(known.select("doc_id", "d.*", "v"), "labelled")
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    share = min(1.0, LABELLED_ROWS / max(1, size["n"]), LABELLED_CHARS / max(1, size["c"] or 0))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * share))

    def run(batches):
        for b in batches:
            cut = [_cut(t) for t in b.column(1).to_pylist()]
            new = [pa.array([k for k, _, _ in cut], pa.list_(pa.string())), pa.array([[len(u) for u in d] for _, d, _ in cut], pa.list_(pa.int32()))]
            new += [pa.array([[w for u in d for w in u] for _, d, _ in cut], pa.list_(pa.string())), pa.array([x for _, _, x in cut], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *new], ["doc_id", "source", "v", "kinds", "sizes", "words", "tongue"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    own = sample.select("doc_id", "text", "source", "v").mapInArrow(run, f"doc_id {kind}, source string, v array<struct<subject:string,n:long>>, kinds array<string>, sizes array<int>, words array<string>, tongue int")
    t = own.toArrow().sort_by("doc_id")  # bounded by LABELLED_ROWS and LABELLED_CHARS
    votes_of = [{x["subject"]: float(x["n"]) for x in v} for v in t.column("v").to_pylist()]
    return learn(_numbered(t.column("kinds").to_pylist(), t.column("sizes").to_pylist(), t.column("words").combine_chunks().flatten(), t.column("tongue").to_pylist(), t.column("source").to_pylist(), votes_of), names)


def unit_shares(documents: DataFrame, model: ChainModel) -> DataFrame:
    """(doc_id, subject, n_units, about, share, confidence) of each subject that a unit of the document is about.

    Null, empty and blank texts and those without a sentence or row have no row;
    repeated rows are answered as often.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = held.value
        memo: dict[str, np.ndarray] = {}
        s = len(m.subjects)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, texts, sources = (part.column(i).to_pylist() for i in range(3))
                xs, own, rows = [], [], []
                for i, t in enumerate(texts):
                    d = [u for u in units(t or "") if u[0] != "h"] if s else []
                    if not d:
                        continue
                    fresh = [t for _, t in d if t not in memo]
                    if fresh:
                        if len(memo) > 200_000:
                            memo.clear()
                            fresh = [t for _, t in d]
                        for t2, row in zip(fresh, m.score(fresh)):
                            memo[t2] = row
                    sc = np.stack([memo[t] for _, t in d])
                    xs.append(m.features(sc, [k for k, _ in d], source_kind(sources[i]), sc.mean(0)))
                    own.append((i, len(d)))
                if xs:
                    y, p = m.decode(np.vstack(xs))
                    lo = 0
                    for i, n in own:
                        about, conf = y[lo : lo + n], p[lo : lo + n]
                        lo += n
                        for j in range(s):
                            k = int(about[:, j].sum())
                            if k:
                                rows.append((ids[i], m.subjects[j], n, k, k / n, float(conf[about[:, j]].mean())))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [part.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "subject", "n_units", "about", "share", "confidence"])

    return documents.select("doc_id", "text", "source").mapInArrow(run, f"doc_id {kind}, subject string, n_units int, about int, share double, confidence double")


def document_subjects(documents: DataFrame, model: ChainModel, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject) of each subject that at least ``least`` of the units are about."""
    return unit_shares(documents, model).where(F.col("share") >= least - 1e-9).select("doc_id", "subject").distinct()
