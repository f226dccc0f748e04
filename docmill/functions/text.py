"""Cleaning, tokenising and parsing of text, as column functions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that vision models put around extracted text.
MARKERS = ("## START OF EXTRACTED TEXT", "## END OF EXTRACTED TEXT", "START OF EXTRACTED TEXT", "END OF EXTRACTED TEXT")
# A Markdown table, that is a header row, a rule and at least one row.
TABLE = r"(?m)(?:^[ \t]*\|.*\r?\n)(?:^[ \t]*\|[-\s|:]+\r?\n)(?:^[ \t]*\|.*\r?\n?)+"
WORD = r"[\p{L}\p{N}_]+"
TOKENS_PER_WORD = 1.3
# File names that say nothing.
GENERIC_NAMES = (
    r"^doc(ument)?s?$", r"^files?$", r"^fichiers?$", r"^scans?$", r"^untitled", r"^sans[_ ]titre", r"^copie", r"^copy", r"^new$", r"^nouveau", r"^temp$",
    r"^draft$", r"^brouillon$", r"^dossier", r"^folder", r"^\d+$", r"^.{1,2}$", r"^(doc|file|scan|img|page|image|photo)[_\-]?\d+$", r"^img_\d+$",
)
_BLANKS = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """White space removed from both ends, line ends included."""
    return F.regexp_replace(c, _BLANKS, "")


def unfence(c: Column) -> Column:
    """Without the code fence that wraps the whole text; null stays null."""
    t = strip(c)
    t = F.when(t.startswith("```markdown"), strip(F.substring(t, len("```markdown") + 1, 1 << 30))).otherwise(t)
    t = F.when(t.startswith("```"), strip(F.substring(t, 4, 1 << 30))).otherwise(t)
    return F.when(t.endswith("```"), strip(F.regexp_replace(t, r"```$", ""))).otherwise(t)


def clean_extracted_text(c: Column) -> Column:
    """Model output without its fence and markers, at most two blank lines in a row."""
    t = unfence(c)
    for m in MARKERS:
        t = F.replace(t, F.lit(m), F.lit(""))
    return strip(F.regexp_replace(t, r"\n{4,}", "\n\n\n"))


def clean_table_output(c: Column) -> Column:
    """A table without its fence, at most one blank line in a row."""
    return strip(F.regexp_replace(unfence(c), r"\n{3,}", "\n\n"))


def markdown_tables(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TABLE), F.lit(0))


def remove_tables(c: Column) -> Column:
    return F.regexp_replace(c, TABLE, "")


def remove_code_blocks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)```.*?```", "")


def remove_named_blocks(c: Column, name: str) -> Column:
    return F.regexp_replace(c, rf"(?s)```{name}.*?```", "")


def clean_up(c: Column) -> Column:
    """Without code blocks, diagrams and tables."""
    return remove_tables(remove_named_blocks(remove_code_blocks(c), "mermaid"))


def markdown_to_plain(c: Column) -> Column:
    """Text of Markdown: marks of headings, emphasis, links, images, code, lists, quotes and rules removed."""
    t = F.regexp_replace(c, r"(?s)```[a-zA-Z]*\n?(.*?)```", "$1")
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^[ \t]*([-*_])([ \t]*\1){2,}[ \t]*$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]{0,3}(#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d+\.[ \t]+)", "")
    t = F.regexp_replace(t, r"(\*\*|__)(.+?)\1", "$2")
    t = F.regexp_replace(t, r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", "$1")
    return F.regexp_replace(t, r"`([^`]*)`", "$1")


def html_to_plain(c: Column) -> Column:
    """Text of HTML: scripts, styles, comments and tags removed, common entities resolved."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def token_count(c: Column) -> Column:
    """Tokens estimated from words."""
    return F.floor(F.size(words(c)) * F.lit(13) / F.lit(10)).cast("int")


def fenced_json(c: Column) -> Column:
    """What stands in the first json fence, else the text."""
    inner = F.regexp_extract(c, r"(?s)```json(.*?)```", 1)
    return F.when(c.rlike(r"(?s)```json.*?```"), inner).otherwise(c)


def recover_json(c: Column) -> Column:
    """The text as parsed JSON (as text), single quotes tried as double ones, else as it is; without a brace as it is."""
    inner = fenced_json(c)
    tried = F.coalesce(F.to_json(F.try_parse_json(inner)), F.to_json(F.try_parse_json(F.replace(inner, F.lit("'"), F.lit('"')))), inner)
    return F.when(c.contains("{"), tried).otherwise(c)


# Other names of the fields of an answer.
FIELD_NAMES = {
    "name": ("nom", "name"), "type": ("type", "type_entite", "type_entité", "relation", "relationship_type", "type_relation"), "description": ("description",),
    "confidence": ("confiance", "confidence"), "source": ("source", "source_entity", "entite_source", "entité_source"),
    "target": ("target", "target_entity", "cible", "entite_cible", "entité_cible"), "attributes": ("attributes", "attributs"),
}


def json_from_response(c: Column, key: str) -> Column:
    """A JSON array (as text) from a model's answer: whole, fenced, the outermost brackets, or the outermost braces.

    An object gives its ``key``, an empty list without it; nothing usable gives
    null. Names of fields that answers in French have are put into English.
    """
    candidates = [c, fenced_json(c), F.regexp_extract(c, r"(?s)\[.*\]", 0), F.regexp_extract(c, r"(?s)\{.*\}", 0)]
    as_list = []
    for x in candidates:
        v = F.to_json(F.try_parse_json(x))
        inner = F.get_json_object(v, f"$.{key}")
        as_list.append(F.when(v.startswith("["), v).when(v.startswith("{") & inner.startswith("["), inner).when(v.startswith("{"), "[]"))
    out = F.coalesce(*as_list)
    for name, others in FIELD_NAMES.items():
        # quotes inside of texts are escaped, so only names stand between a bare quote and a colon
        out = F.regexp_replace(out, rf'(?iu)([{{,])"(?:{"|".join(others)})":', f'$1"{name}":')
    return out


def verdict_from_response(c: Column) -> Column:
    """(same_entity, confidence, canonical_name) of a model's verdict on two entities; unreadable ones are 'not the same'."""
    shape = "same_entity boolean, confidence double, canonical_name string"
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    whole = fenced_json(c)
    v = F.from_json(F.when(F.try_parse_json(whole).isNotNull(), whole).otherwise(braces), shape)
    return F.struct(F.coalesce(v["same_entity"], F.lit(False)).alias("same_entity"), F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"), v["canonical_name"].alias("canonical_name"))


def classification_from_response(c: Column) -> Column:
    """(type, confidence, entities, reasoning) of the line protocol TYPE: / CONFIDENCE: / ENTITIES: / REASONING:."""
    line = lambda name: strip(F.regexp_extract(c, rf"(?im)^\s*{name}:[ \t]*(.*)$", 1))
    entities = F.filter(F.transform(F.split(F.regexp_replace(line("ENTITIES"), r"[\[\]]", ""), ","), strip), lambda x: (x != "") & (F.lower(x) != "none"))
    return F.struct(F.lower(line("TYPE")).alias("type"), F.coalesce(line("CONFIDENCE").try_cast("double"), F.lit(0.5)).alias("confidence"), entities.alias("entities"), line("REASONING").alias("reasoning"))


def bullets(c: Column) -> Column:
    """Items of the lines that begin with '- ' or '* '."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.transform(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ")), lambda x: strip(F.substring(x, 3, 1 << 30)))


def expanded_queries(c: Column, most: int = 5) -> Column:
    """Bullets after 'Expanded Queries:' after 'Step 3'; none without that mark."""
    after = F.regexp_extract(c, r"(?s)Step 3(.*)", 1)
    listed = F.regexp_extract(after, r"(?s)Expanded Queries:[^\n]*\n(.*)", 1)
    lines = F.filter(F.transform(F.split(listed, "\n"), strip), lambda x: x.startswith("-"))
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[- ]+", "")), 1, most)


def normalize_query(c: Column) -> Column:
    """Lower case, single blanks, no punctuation at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\s+", " "), r"[?.!,;:]+$", "")


def normalize_spaces(c: Column) -> Column:
    """Lower case and single blanks, as the key of a graph result."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def chunk_kind(name: Column) -> Column:
    """(is_parent_only, is_child, is_description, is_table) by a chunk's name."""
    parent, child = name.contains("_parent_chunk_"), name.contains("_child_chunk_")
    return F.struct((parent & ~child).alias("is_parent_only"), child.alias("is_child"), name.contains("_description_").alias("is_description"), name.contains("_Table_").alias("is_table"))


def stem_of(name: Column) -> Column:
    """The source's stem of a chunk's name, which stem filters compare as a whole."""
    return F.substring_index(name, "_page_", 1)


def entity_text(name: Column, description: Column) -> Column:
    """What of an entity is embedded."""
    return F.when(F.coalesce(strip(description), F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), description))


def normalize_name(c: Column) -> Column:
    return F.lower(strip(c))


def matches_name(query: Column, name: Column, aliases: Column) -> Column:
    """Whether a name or alias equals the query, case apart."""
    q = normalize_name(query)
    return (normalize_name(name) == q) | F.coalesce(F.exists(aliases, lambda a: normalize_name(a) == q), F.lit(False))


def is_generic_name(c: Column) -> Column:
    """Whether a file's or folder's name says nothing about its content."""
    stem = F.lower(strip(F.regexp_replace(F.regexp_extract(c, r"([^/]*)/?$", 1), r"(?<=.)\.[^.]*$", "")))
    return stem.rlike("|".join(f"(?:{p})" for p in GENERIC_NAMES))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words as a share of the smaller set; 0 if one is empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def chunk_metadata(name: Column) -> Column:
    """(child, parent, document, page) from a chunk's file name."""
    parent = (
        F.when(name.contains("_child_chunk_"), F.concat(F.substring_index(name, "_child_chunk_", 1), F.lit(".txt")))
        .when(name.contains("_description_"), F.concat(F.substring_index(name, "_chunk_", 1), F.lit(".txt")))
        .when(name.contains("_Table_"), F.concat(F.substring_index(name, "_chunk_", 1), F.lit(".md")))
    )
    paged = name.contains("_page_")
    document = F.when(paged, F.replace(F.substring_index(name, "_page_", 1), F.lit("__"), F.lit("/")))
    page = F.when(paged, F.regexp_extract(name, r"_page_([^_]*)", 1))
    return F.struct(name.alias("child"), parent.alias("parent"), document.alias("document"), page.alias("page"))


def encode_path(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("__"))


def decode_path(c: Column) -> Column:
    return F.replace(c, F.lit("__"), F.lit("/"))


def page_range(pages: Column) -> Column:
    """'p. n', 'pp. a-b' for pages without a gap, else the first three."""
    p = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull())))
    n, first, last = F.size(p), F.element_at(p, 1), F.element_at(p, -1)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.concat(F.lit("p. "), first.cast("string")))
        .when(last - first + 1 == n, F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))
        .otherwise(F.concat(F.lit("pp. "), F.array_join(F.slice(p, 1, 3).cast("array<string>"), ", "), F.when(n > 3, "...").otherwise("")))
    )


def excerpt(c: Column, most: int) -> Column:
    """The first ``most`` characters, with dots where it was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


# What the messages of failing services say, in order of precedence.
QUOTA = ("resource_exhausted", "quota", "exceeded your current quota", "billing", "insufficient_quota", "quota_exceeded")
RATE = ("rate limit", "ratelimit", "rate_limit", "429", "too many requests", "request rate exceeded", "throttl")
TRANSIENT = ("timeout", "connection", "network", "temporarily unavailable", "service unavailable", "503", "502", "504", "gateway")
# Exception types that mean the same whatever they say.
QUOTA_TYPES = ("ResourceExhausted", "QuotaExceeded")
RATE_TYPES = ("RateLimitError", "TooManyRequestsError")
TRANSIENT_TYPES = ("ConnectionError", "TimeoutError", "HTTPStatusError", "ConnectError", "ReadTimeout", "WriteTimeout")


def error_type(message: Column, kind: Column | None = None) -> Column:
    """QUOTA_EXHAUSTED, RATE_LIMITED, TRANSIENT or PERMANENT, by message and exception type."""
    low = F.lower(F.coalesce(message, F.lit("")))
    kind = F.coalesce(kind, F.lit("")) if kind is not None else F.lit("")
    says = lambda xs: low.rlike("|".join(xs))
    return (
        F.when(says(QUOTA) | kind.isin(*QUOTA_TYPES), "QUOTA_EXHAUSTED")
        .when(says(RATE) | kind.isin(*RATE_TYPES), "RATE_LIMITED")
        .when(says(TRANSIENT) | kind.isin(*TRANSIENT_TYPES), "TRANSIENT")
        .otherwise("PERMANENT")
    )
