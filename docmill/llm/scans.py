"""Problem 5: text of scanned pages, as continuous paragraphs, and the defects found on the way.

Running headers are the lines that recur over the chunks of a document once page
numbers, case, accents and look-alike characters are folded away; page numbers
are the numerals whose distance from the page is the same all over the document.
What is left is joined across line ends. Misread words are found over the whole
corpus: every frequent word gets a skip-gram vector (a factorisation of its
pointwise mutual information with its neighbours, which is the optimum that
negative sampling tends to), a rare word is linked to the frequent ones that
plausible glyph edits turn into it, and at each place where it stands the vectors
of its neighbours decide whether it is one of these or a word of its own.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import stage

#: A header recurs on this many chunks of its document and this share of them (or, if it looks like a title, on more).
HEADER_CHUNKS, HEADER_SHARE, TITLE_CHUNKS = 3, 0.3, 5
#: A word is frequent from this count, and a rare word is at most this fraction of the frequent one.
FREQUENT, RARER = 5, 8
#: Neighbours on either side that are contexts, buckets of contexts (half of them for each side), and size of the vectors.
REACH, CONTEXT_BUCKETS, RANK = 2, 1024, 64
#: Log odds of a misreading before its context is seen: of a word with signs inside, and less for each edit of one without.
SURE, PER_EDIT = 4.0, 3.0

# What scanning makes of a character, and what it was. Marks and digits inside a word are certain signs.
GLYPHS = {
    "c": ("e",), "f": ("t",), "b": ("h",), "q": ("g",), "cl": ("d",), "rn": ("m",), "vv": ("w",), "ii": ("u",), "li": ("h",),
    "0": ("o",), "1": ("l", "i"), "!": ("i", "l"), "|": ("l", "i"), "$": ("s",), "5": ("s",), "@": ("a",), "3": ("e",), "4": ("a",), "6": ("b",), "8": ("b",), "9": ("g",),
}
MARKS = "01!|$5@34689"
#: Letters under which all glyph edits coincide: the words before and after a misreading have the same key.
_ALIKE = ("ei!|1fq90$5@43", "clllltggossaac")
_WIDE = (("d", "cl"), ("m", "rn"), ("w", "vv"), ("u", "ll"), ("[hb68]", "ll"))
_LOOK_ALIKE = str.maketrans({**{k: w[0] for k, w in GLYPHS.items() if len(k) == 1}, "!": "l", "i": "l", "9": "g"})
TOKEN = r"[\p{L}\p{M}\p{N}@$!|]+(?:['’-][\p{L}\p{M}\p{N}@$!|]+)*"
_TOKEN = regex.compile(TOKEN)
_NUMERAL = r"(?:\d{1,5}|[ivxlc]{1,8})"
_PAGE = regex.compile(
    rf"[\[\](){{}}—–\-~·•.\s]*(?:(?:page|seite|pagina|página|pág|pag|bladzijde|blz|p|s)\.?\s*)?(?P<n>{_NUMERAL})(?:\s*(?:of|von|di|de|do|da|sur|van|/)\s*\d{{1,5}})?(?:\s*\|\s*\p{{L}}{{1,12}})?[\[\](){{}}—–\-~·•\s]*",
    regex.I,
)
_SPLIT = regex.compile(r"\s{2,}")
_HEADING = regex.compile(r"(\d+\.(\d+\.?)*\s|#+\s|[*•>|])")
_SENTENCE_END = regex.compile(r"[.!?;,:…][\"'”’»)\]]*$")
_STOP = regex.compile(r"[.!?…:][\"'”’»)\]]*$")
_TAIL, _FRONT = regex.compile(r"[\p{L}\p{M}@$!|0-9'’-]+$"), regex.compile(r"[\p{L}\p{M}@$!|0-9'’-]+")
_BARE = regex.compile(r"(?<!\S)[\d\W]+(?!\S)")
_NUMBERED = regex.compile(r"\d|(?:^|\s)[ivxlcIVXLC]{1,8}(?:\s|$)")
_BROKEN = regex.compile(r"[\p{L}\p{M}@$!|0-9'’-]*[\p{L}@$!|01]([-‐‑¬­])\s*$")


def roman(text: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(text, [*text[1:], ""]):
        total += -value[a] if b and value[a] < value[b] else value[a]
    back, n = "", total
    for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
        back, n = back + s * (n // v), n % v
    return total if back == text else None


def page_value(text: str) -> int | None:
    """The number, if ``text`` is nothing but a page number in some dress."""
    m = _PAGE.fullmatch(text.strip())
    if not m or text.strip().endswith("."):
        return None
    n = m["n"].lower()
    return int(n) if n.isdigit() else roman(n)


class _Letters(dict):
    """Look-alike letters made equal, everything but letters left out."""

    def __missing__(self, c: int) -> str | None:
        self[c] = x = chr(c) if chr(c).isalpha() else None
        return x


_FOLD = _Letters(_LOOK_ALIKE)


def folded(text: str) -> str:
    """Letters only, without case and accents, look-alikes made equal."""
    t = _BARE.sub(" ", unicodedata.normalize("NFD", text.lower()))
    for seen in ("rn", "cl", "vv"):
        t = t.replace(seen, GLYPHS[seen][0])
    return t.translate(_FOLD)


def line_key(line: str) -> tuple[str, list[int]]:
    """(key, numbers) of a line: its folded words, and every number in it that may be the page's."""
    s = line.strip()
    if not s:
        return "-", []
    numbered = _NUMBERED.search(s) is not None
    own = page_value(s) if numbered else None
    if own is not None:
        return "", [own]
    if _HEADING.match(s) and not regex.match(r"[-—–•*|>]\s*\d", s):
        return "-", []
    if not numbered:
        if _SENTENCE_END.search(s[-8:]):
            return "-", []
        key = folded(s)
        return (key if len(key) >= 4 else "-"), []
    numbers, words = [], s.split()
    core = s
    # a page number stands at either end, mostly apart from the words
    parts = _SPLIT.split(s)
    if len(parts) > 1:
        kept = []
        for i, p in enumerate(parts):
            v = page_value(p) if i in (0, len(parts) - 1) else None
            if v is None:
                kept.append(p)
            else:
                numbers.append(v)
        core = " ".join(kept)
    if not numbers:
        for n in (5, 4, 3, 2, 1):
            if len(words) > n:
                for piece, rest in ((words[:n], words[n:]), (words[-n:], words[:-n])):
                    v = page_value(" ".join(piece))
                    if v is not None and not numbers:
                        numbers.append(v)
                        if not (len(piece) == 1 and piece[0].isdigit() and len(piece[0]) == 4):
                            core = " ".join(rest)
            if numbers:
                break
    if _SENTENCE_END.search(core[-8:]):
        return "-", []
    key = folded(core)
    return (key if len(key) >= 4 else "-"), numbers


def _title_like(line: str) -> bool:
    words = [w for w in line.split() if w[:1].isalpha()]
    return len(words) >= 2 and 2 * sum(w[:1].isupper() for w in words) >= len(words)


def chunks_of(extraction: DataFrame) -> DataFrame:
    """(chunk_id, document, page, text) once for each chunk; of differing repeats the smallest text.

    A chunk without a document is one of its own, without a page.
    """
    rows = extraction.where("chunk_id is not null and chunk_text is not null")
    once = rows.groupBy("chunk_id").agg(F.min(F.struct("document", "page", "chunk_text")).alias("r"))
    lone = F.col("r.document").isNull()
    own = F.when(lone, F.concat(F.lit("\x00"), "chunk_id")).otherwise(F.col("r.document"))
    return once.select("chunk_id", own.alias("document"), F.when(~lone, F.col("r.page").cast("int")).alias("page"), F.col("r.chunk_text").alias("text"))


_MARK = pa.struct([("at", pa.int32()), ("key", pa.string()), ("numbers", pa.list_(pa.int32())), ("title", pa.bool_())])


def marked_lines(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``marks``: the place, key and numbers of each line that can be furniture."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                own = []
                for at, line in enumerate(text.split("\n")):
                    key, numbers = line_key(line)
                    if key != "-":
                        own.append((at, key, numbers, _title_like(line)))
                out.append([{"at": a, "key": k, "numbers": n, "title": t} for a, k, n, t in own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(_MARK))], [*b.schema.names, "marks"])

    shape = "chunk_id string, document string, page int, text string, marks array<struct<at:int,key:string,numbers:array<int>,title:boolean>>"
    return chunks.select("chunk_id", "document", "page", "text").mapInArrow(run, shape)


def furniture(marked: DataFrame) -> DataFrame:
    """(chunk_id, gone, header, page_number): the places of the lines that are furniture, and what kinds there are."""
    lines = marked.select("document", "page", "chunk_id", F.inline("marks"))
    size = marked.groupBy("document").agg(F.count("*").alias("n_chunks"))
    recur = lines.where("key <> ''").groupBy("document", "key", "chunk_id").agg(F.max("title").alias("title"))
    recur = recur.groupBy("document", "key").agg(F.count("*").alias("n"), F.avg(F.col("title").cast("int")).alias("title"))
    heads = recur.where(F.col("n") >= HEADER_CHUNKS).join(size, "document")
    heads = heads.where((F.col("n") >= HEADER_SHARE * F.col("n_chunks")) | ((F.col("n") >= TITLE_CHUNKS) & (F.col("title") >= 0.5)))
    heads = stage(heads.select("document", "key", F.lit(True).alias("head")), "headers")
    either = lines.join(heads, ["document", "key"], "left").where("key = '' or head")
    either = stage(either.select("document", "page", "chunk_id", "at", (F.col("key") == "").alias("alone"), "numbers"), "furniture")
    apart = either.where("size(numbers) > 0 and page is not null").select("document", (F.col("numbers")[0] - F.col("page")).alias("offset"), "page", "alone")
    votes = apart.groupBy("document", "offset", "page").agg(F.max("alone").alias("alone")).groupBy("document", "offset").agg(F.count("*").alias("pages"), F.max("alone").alias("alone"))
    best = votes.groupBy("document").agg(F.max(F.struct("pages", "alone", (-F.abs("offset")).alias("near"), "offset")).alias("b"))
    best = best.where("b.pages > 1 or b.alone or b.offset = 0").select("document", F.col("b.offset").alias("offset"))
    right = F.coalesce(F.exists("numbers", lambda n: n - F.col("page") == F.col("offset")), F.lit(False))
    judged = either.join(best, "document", "left").withColumn("right", right).where("right or not alone")
    return judged.groupBy("chunk_id").agg(F.collect_set("at").alias("gone"), F.max(~F.col("alone")).alias("header"), F.max("right").alias("page_number"))


def join_lines(lines: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """Paragraphs of lines joined across their ends, and the (left, right) parts of words that a plain hyphen divides.

    The place of such a division is kept as U+0001 for later, since only the
    vocabulary tells a divided word from a compound. Soft signs are removed, and
    give ('', '') as parts.
    """
    out: list[str] = []
    parts: list[tuple[str, str]] = []
    held = ""
    blank = False
    for line in lines:
        s = line.strip()
        if not s:
            blank = True
            continue
        if held:
            sign = held[-1]
            left = _TAIL.search(held[-80:-1])
            right = _FRONT.match(s)
            if right and left and (s[:1].islower() or s[:1] in MARKS or held[-2:-1].isupper() and s[:1].isupper()):
                if sign == "-":
                    parts.append((left[0].lower(), right[0].lower()))
                    out[-1] = held[:-1] + "\x01" + s
                else:
                    parts.append(("", ""))
                    out[-1] = held[:-1] + s
            elif sign != "-" and left:
                parts.append(("", ""))
                out[-1] = held[:-1] + s
            else:
                out[-1] = held + " " + s
        elif out and not (blank and _STOP.search(out[-1][-8:])) and not _HEADING.match(s):
            # furniture may have left a blank line inside a sentence
            if blank and not s[0].islower():
                out.append(s)
            else:
                out[-1] += " " + s
        else:
            out.append(s)
        blank = False
        held = out[-1] if s[-1] in "-‐‑¬\xad" and _BROKEN.search(out[-1][-80:]) else ""
    if held:
        parts.append(("", "") if held[-1] != "-" else (regex.search(r"[^\s]+$", held[:-1])[0].lower(), ""))
    return "\n".join(out), parts


def running_text(marked: DataFrame, furnish: DataFrame) -> DataFrame:
    """(chunk_id, header, page_number, body, left, right, words): chunks without furniture, joined, with their divided and all their words."""

    def run(batches):
        for b in batches:
            rows = []
            for cid, text, gone, header, number in zip(*(c.to_pylist() for c in b.columns)):
                out = set(gone or ())
                body, parts = join_lines([line for i, line in enumerate(text.split("\n")) if i not in out])
                rows.append((cid, bool(header), bool(number), body, [a for a, _ in parts], [z for _, z in parts]))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["chunk_id", "header", "page_number", "body", "left", "right"])

    joined = marked.join(furnish, "chunk_id", "left").select("chunk_id", "text", "gone", "header", "page_number")
    bodies = joined.mapInArrow(run, "chunk_id string, header boolean, page_number boolean, body string, left array<string>, right array<string>")
    whole = F.translate(F.lower(F.replace("body", F.lit("\x01"), F.lit(""))), "’", "'")
    return bodies.withColumn("words", F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)))


def _beside(codes: Column, i: Column) -> Column:
    """The context buckets of the word at place ``i``: of the words before it, and of those after it."""
    half = CONTEXT_BUCKETS // 2
    before = [F.get(codes, i - k) for k in range(REACH, 0, -1)]
    after = [F.get(codes, i + k) + half for k in range(1, REACH + 1)]
    return F.array_compact(F.array(*before, *after))


def occurrences(bodies: DataFrame) -> DataFrame:
    """(chunk_id, at, w, ctx): every word with its place and the context buckets beside it."""
    coded = bodies.select("chunk_id", "words", F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(CONTEXT_BUCKETS // 2)).cast("int")).alias("codes"))
    each = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"), _beside(F.col("codes"), i).alias("ctx")))
    return coded.select("chunk_id", F.inline(each))


def vocabulary_of(bodies: DataFrame) -> DataFrame:
    """(w, n): how often each word is written."""
    return bodies.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def glyph_edits(before: str, after: str) -> int:
    """How many misreadings turn one word into the other, -1 if none do; signs inside a word are always misreadings."""
    best = {(0, 0): 0}
    for i in range(len(before)):
        nxt: dict[tuple[int, int], int] = {}
        for (_, j), n in best.items():
            if j < len(after) and after[j] == before[i] and after[j] not in MARKS:
                nxt[i + 1, j + 1] = min(n, nxt.get((i + 1, j + 1), n))
            for k in (1, 2):
                if j + k <= len(after) and before[i] in GLYPHS.get(after[j : j + k], ()):
                    nxt[i + 1, j + k] = min(n + 1, nxt.get((i + 1, j + k), n + 1))
        best = nxt
    return best.get((len(before), len(after)), -1)


def glyph_key(w: Column) -> Column:
    """The same for all words that glyph edits may turn into each other."""
    k = F.translate(w, *_ALIKE)
    for seen, wide in _WIDE:
        k = F.regexp_replace(k, seen, wide)
    return k


def word_links(vocabulary: DataFrame) -> DataFrame:
    """(w, n, v, nv, edits, sure): words with the frequent ones that any number of glyph edits turn into them.

    A word with signs inside (``sure``) may be as frequent as what it stands for,
    another at most an RARER-th of it.
    """
    keyed = vocabulary.where(F.col("w").rlike(r"\p{L}")).withColumn("k", glyph_key(F.col("w"))).withColumn("sure", F.col("w").rlike("[" + MARKS.replace("|", r"\|") + "]"))
    known = keyed.where(~F.col("sure") & (F.col("n") >= FREQUENT)).select("k", F.col("w").alias("v"), F.col("n").alias("nv"))
    pairs = keyed.join(known, "k").where((F.col("w") != F.col("v")) & (F.col("nv") >= F.col("n") * F.when(F.col("sure"), 1).otherwise(RARER)))

    def run(batches):
        for b in batches:
            edits = pa.array([glyph_edits(v, w) for w, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist())], pa.int32())
            t = pa.RecordBatch.from_arrays([*b.columns, edits], ["w", "n", "v", "nv", "sure", "edits"])
            yield t.filter(pa.compute.greater(edits, 0))

    return pairs.select("w", "n", "v", "nv", "sure").mapInArrow(run, "w string, n long, v string, nv long, sure boolean, edits int")


def word_vectors(places: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Vectors (w, vec) of all frequent words, and those of the context buckets.

    The matrix of positive pointwise mutual information between words and buckets
    is factorised: its square over the buckets is added up over the cluster
    (CONTEXT_BUCKETS squared numbers, whatever the corpus), its main axes are the
    vectors of the buckets, and a word's row along these axes is its own. The
    product of a word's vector with a bucket's is then what of their mutual
    information is not chance.
    """
    pair = places.select("w", F.explode("ctx").alias("ctx")).groupBy("w", "ctx").agg(F.count("*").alias("n"))
    pair = stage(pair, "contexts")
    all_n = F.broadcast(pair.groupBy("ctx").agg(F.sum("n").alias("nc")))  # CONTEXT_BUCKETS rows
    total = pair.agg(F.sum("n")).scalar()
    frequent = vocabulary.where(F.col("n") >= FREQUENT).select("w")
    known = pair.join(frequent, "w").withColumn("nw", F.sum("n").over(Window.partitionBy("w")))
    mutual = F.log(F.col("n") * total / (F.col("nw") * F.col("nc")))
    row = known.join(all_n, "ctx").where(mutual > 0).groupBy("w").agg(F.collect_list(F.struct("ctx", mutual.cast("float").alias("x"))).alias("row"))
    rows = stage(row, "mutual")

    def dense(column) -> Iterator[np.ndarray]:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        starts, inner = lists.offsets.to_numpy(), lists.values
        ctx, x = inner.field("ctx").to_numpy(), inner.field("x").to_numpy()
        for lo in range(0, len(lists), 1000):
            hi = min(len(lists), lo + 1000)
            m = np.zeros((hi - lo, CONTEXT_BUCKETS), np.float32)
            own = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            m[own, ctx[starts[lo] : starts[hi]]] = x[starts[lo] : starts[hi]]
            yield m

    def square(batches):
        g = np.zeros((CONTEXT_BUCKETS, CONTEXT_BUCKETS), np.float64)
        for b in batches:
            for m in dense(b.column(1)):
                g += m.T @ m
        if g.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXT_BUCKETS), pa.int32()), pa.array(list(g.astype(np.float32)), pa.list_(pa.float32()))], ["i", "g"])

    def add(key, t):
        g = t.column("g").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(0, dtype=np.float64)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([g.astype(np.float32)], pa.list_(pa.float32()))})

    shape = "i int, g array<float>"
    found = rows.mapInArrow(square, shape).groupBy("i").applyInArrow(add, shape).toArrow()
    gram = np.zeros((CONTEXT_BUCKETS, CONTEXT_BUCKETS))
    if found.num_rows:
        gram[found.column("i").to_numpy()] = found.column("g").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    axes = main_axes(gram, RANK)
    held = rows.sparkSession.sparkContext.broadcast(axes.astype(np.float32))  # CONTEXT_BUCKETS x RANK

    def project(batches):
        for b in batches:
            vecs = [v for m in dense(b.column(1)) for v in m @ held.value]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.list_(pa.float32()))], ["w", "vec"])

    return rows.mapInArrow(project, "w string, vec array<float>"), axes


def main_axes(square: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The ``rank`` main eigenvectors of a symmetric matrix, by subspace iteration."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(len(square), rank + 16)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(square @ q)[0]
    values, turn = np.linalg.eigh(q.T @ square @ q)
    return q @ turn[:, np.argsort(-values)[:rank]]


def log_odds(n: Column, nv: Column, edits: Column, sure: Column, fit: Column, own: Column) -> Column:
    """Log odds that a word written ``n`` times is a misreading of one written ``nv`` times, at a place of given fit with both."""
    prior = F.when(sure, SURE).otherwise(-PER_EDIT * edits)
    return prior + F.log(nv / n) + fit - own


def misread(bodies: DataFrame) -> DataFrame:
    """(chunk_id, at, w, correct): the places of misread words, with what stands there.

    Each place is decided by itself (:func:`log_odds`): the same letters can be a
    misreading in one context and a word of their own in another.
    """
    vocabulary = stage(vocabulary_of(bodies), "vocabulary")
    links = stage(word_links(vocabulary), "links")
    places = occurrences(bodies)
    vectors, axes = word_vectors(places, vocabulary)
    vectors = stage(vectors.join(links.select(F.col("v").alias("w")).unionByName(links.select("w")).distinct(), "w", "left_semi"), "vectors")
    held = bodies.sparkSession.sparkContext.broadcast(axes.astype(np.float32))  # CONTEXT_BUCKETS x RANK

    def run(batches):
        for b in batches:
            v, w = (_padded(b.column(i)) for i in (4, 5))
            fit = np.zeros((b.num_rows, 2))
            ctx = b.column(3)
            starts, flat = ctx.offsets.to_numpy(), ctx.values.to_numpy()
            own = np.repeat(np.arange(b.num_rows), np.diff(starts))
            c = held.value[flat[starts[0] : starts[-1]]]
            for k, m in enumerate((v, w)):
                np.add.at(fit[:, k], own, (m[own] * c).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *b.columns[6:], pa.array(fit[:, 0]), pa.array(fit[:, 1])], ["chunk_id", "at", "w", "v", "n", "nv", "edits", "sure", "fit", "own"])

    here = places.join(links, "w").join(vectors.withColumnsRenamed({"w": "v", "vec": "vec_v"}), "v", "left").join(vectors.withColumnRenamed("vec", "vec_w"), "w", "left")
    here = here.select("chunk_id", "at", "w", "ctx", "vec_v", "vec_w", "v", "n", "nv", "edits", "sure")
    scored = here.mapInArrow(run, "chunk_id string, at int, w string, v string, n long, nv long, edits int, sure boolean, fit double, own double")
    odds = F.round(log_odds(F.col("n"), F.col("nv"), F.col("edits"), F.col("sure"), F.col("fit"), F.col("own")), 3)
    best = scored.withColumn("odds", odds).where(F.col("odds") > 0).groupBy("chunk_id", "at", "w").agg(F.max(F.struct("odds", "nv", "v")).alias("b"))
    return best.select("chunk_id", "at", "w", F.col("b.v").alias("correct"))


def _padded(column) -> np.ndarray:
    """Vectors as a matrix, zeros for null ones."""
    out = np.zeros((len(column), RANK), np.float32)
    ok = np.asarray(column.is_valid())
    if ok.any():
        out[ok] = column.drop_null().flatten().to_numpy().reshape(-1, RANK)
    return out


def divided(bodies: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk_id, left, right, joined): words divided by a hyphen at a line end; joined tells them from compounds.

    A compound is more often written with its hyphen than without one.
    """
    pairs = bodies.select("chunk_id", F.explode(F.arrays_zip("left", "right")).alias("p")).select("chunk_id", "p.left", "p.right")
    whole = vocabulary.select(F.col("w").alias("whole"), F.col("n").alias("n_whole"))
    dashed = vocabulary.where("w like '%-%'").select(F.col("w").alias("dashed"), F.col("n").alias("n_dashed"))
    named = pairs.withColumn("whole", F.concat("left", "right")).withColumn("dashed", F.concat_ws("-", "left", "right"))
    judged = named.join(whole, "whole", "left").join(dashed, "dashed", "left")
    return judged.select("chunk_id", "left", "right", (F.coalesce("n_whole", F.lit(0)) >= F.coalesce("n_dashed", F.lit(0))).alias("joined"))


def prepare(extraction: DataFrame) -> DataFrame:
    """Running texts of all chunks."""
    marked = stage(marked_lines(chunks_of(extraction)), "chunks")
    return stage(running_text(marked, furniture(marked)), "bodies")


def defects(extraction: DataFrame) -> DataFrame:
    """(chunk_id, defect): hyphenation, misread, header and page_number, each once a chunk.

    Null and empty texts have no defect; repeated rows count once; chunks without
    a document or page can't have page numbers, but the other defects.
    """
    bodies = prepare(extraction)
    kinds = [bodies.where(c).select("chunk_id", F.lit(c).alias("defect")) for c in ("header", "page_number")]
    kinds.append(divided(bodies, vocabulary_of(bodies)).where("joined").select("chunk_id", F.lit("hyphenation").alias("defect")).distinct())
    kinds.append(misread(bodies).select("chunk_id", F.lit("misread").alias("defect")).distinct())
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def repaired(extraction: DataFrame) -> DataFrame:
    """(chunk_id, text): continuous paragraphs without furniture, divided words joined, misread words put right.

    The case of a corrected word follows the letters it replaces. Chunks with a
    null id or text are left out; a chunk of furniture only has an empty text.
    """
    bodies = prepare(extraction)
    words = misread(bodies).groupBy("chunk_id").agg(F.collect_list(F.struct("at", "w", "correct")).alias("fix"))
    compounds = divided(bodies, vocabulary_of(bodies)).where("not joined and left <> ''").groupBy("chunk_id").agg(F.collect_list(F.concat("left", F.lit("\x01"), "right")).alias("dash"))
    joined = bodies.select("chunk_id", "body").join(words, "chunk_id", "left").join(compounds, "chunk_id", "left").select("chunk_id", "body", "fix", "dash")

    def run(batches):
        for b in batches:
            out = []
            for body, fix, dash in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                for d in dash or ():
                    body = regex.sub(regex.escape(d), lambda m: m[0].replace("\x01", "-"), body, flags=regex.I)
                body = body.replace("\x01", "")
                good = {x["at"]: (x["w"], x["correct"]) for x in fix or ()}
                place = itertools.count()

                def put(m, good=good, place=place):
                    seen, w = good.get(next(place), ("", ""))
                    if not w or m[0].lower().replace("’", "'") != seen:
                        return m[0]
                    return w.upper() if len(w) > 1 and m[0].isupper() else w[:1].upper() + w[1:] if m[0][:1].isupper() else w

                out.append(_TOKEN.sub(put, body) if good else body)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["chunk_id", "text"])

    return joined.mapInArrow(run, "chunk_id string, text string")
