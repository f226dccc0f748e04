"""Classification of queries by rules, their weights, complexity and language, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import strip

# What a query of each type says, in order of precedence; English, French, Spanish, German.
QUERY_PATTERNS = {
    "relational": (
        "relationship between", "related to", "connection between", "how (?:does|is|are) .+ (?:related|connected|linked) to", "depends on", "affects?", "impacts?",
        "influences?", "between .+ and .+", "link between", "relation entre", "li[ée][es]? [àa]", "rapport entre", "lien entre", "relaci[oó]n entre",
        "relacionado con", "conexi[oó]n entre", "beziehung zwischen", "verbunden mit", "zusammenhang zwischen",
    ),
    "comparative": (
        "compare", "difference between", "differences? between", r"vs\.?(?:\s|$)", "versus", "better than", "worse than", "similar to", "differ from", "contrast",
        "compar[eé]", "diff[ée]rence entre", "par rapport [àa]", "comparar", "diferencia entre", "mejor que", "peor que", "vergleich", "unterschied zwischen",
        "besser als", "schlechter als",
    ),
    "exploratory": (
        "what are all", "list all", "list the", "give me all", "summarize", "summary of", "overview", "main (?:topics|themes|concepts|ideas|points)",
        "key (?:topics|themes|concepts|ideas|points)", "how many", "enumerate", "r[ée]sum[ée]", "aper[çc]u", "liste[rz]? (?:tous|toutes)", "combien",
        "vue d'ensemble", "resumen", "listar todos", "cu[aá]ntos", "enumerar", "zusammenfassung", "[üu]berblick", "alle auflisten", "wie viele",
    ),
    "procedural": (
        "how (?:do|does|to|can|should)", "steps to", "process (?:for|of|to)", "procedure", "guide (?:for|to|on)", "instructions? (?:for|to|on)", "tutorial",
        "walk me through", "explain how", "comment (?:faire|proc[ée]der|r[ée]aliser)", "[ée]tapes pour", "proc[ée]dure", "guide pour",
        "c[oó]mo (?:hacer|realizar|proceder)", "pasos para", "procedimiento", "gu[ií]a para", "wie (?:kann|soll|mach)", "schritte (?:f[üu]r|zu)", "anleitung", "verfahren",
    ),
    "analytical": (
        "analyze", "analysis of", "evaluate", "assess", "examine", "investigate", "deep dive", "in-depth", "comprehensive", "analyser", "analyse de", "[ée]valuer",
        "examiner", "analizar", "an[aá]lisis de", "evaluar", "examinar", "analysieren", "analyse von", "bewerten", "untersuchen",
    ),
}
# First words of questions, with the type and confidence they give, in order of precedence.
QUESTION_WORDS = (
    (r"^(what|who|where|when|which)\b", "factual", 0.6),
    (r"^(why|how)\b", "analytical", 0.5),
    (r"^(qu[e']|quel[le]?s?|o[uù]|quand|qui|combien)\b", "factual", 0.6),
    (r"^(pourquoi|comment)\b", "analytical", 0.5),
    (r"^(qu[eé]|cu[aá]l|d[oó]nde|cu[aá]ndo|qui[eé]n|cu[aá]nto)\b", "factual", 0.6),
    (r"^(por qu[eé]|c[oó]mo)\b", "analytical", 0.5),
    (r"^(was|wer|wo|wann|welche[rs]?)\b", "factual", 0.6),
    (r"^(warum|wie)\b", "analytical", 0.5),
)
# Weight of the vector and of the graph arm, and the retrieval mode, by type.
WEIGHTS = {
    "factual": (0.7, 0.3, "hybrid"), "relational": (0.2, 0.8, "hybrid"), "comparative": (0.3, 0.7, "hybrid"), "exploratory": (0.1, 0.9, "graph_only"),
    "procedural": (0.8, 0.2, "hybrid"), "analytical": (0.5, 0.5, "hybrid"), "unknown": (0.6, 0.4, "hybrid"),
}
# Signs of an ambiguous query.
AMBIGUOUS = (r"^.{1,15}$", r"\?.*\?", r"\bou\b.*\bou\b", r"\bor\b.*\bor\b")
# Questions about the collection itself; French, Spanish, German, English, any.
DATABASE_META = (
    r"\bcombien de doc", r"\bcombien.{0,20}base\b", r"\bnombre de doc", r"\bbase.{0,15}comprend", r"\bbase.{0,15}contient", r"\btaille de (?:la |cette )?base\b",
    r"\bstatistiques?\b.*\bbase\b", r"\bcette base\b.*\bcombien\b", r"\bla base\b.*\bcombien\b", r"\bliste[rz]?\b.*\bdoc", r"\bnoms?\b.*\bdoc", r"\bdoc.*\bnoms?\b",
    r"\bcite[rz]?\b.*\bdoc", r"\b[eé]num[eè]re[rz]?\b.*\bdoc", r"\bquels?\b.*\bdoc", r"\bdonne.*\bnoms?\b",
    r"\bcu[aá]ntos? doc", r"\bcu[aá]ntos?.{0,20}base\b", r"\bn[uú]mero de doc", r"\bbase.{0,15}contiene", r"\bbase.{0,15}tiene", r"\btama[ñn]o de (?:la |esta )?base\b",
    r"\bestad[ií]sticas?\b.*\bbase\b", r"\besta base\b.*\bcu[aá]ntos?\b", r"\bla base\b.*\bcu[aá]ntos?\b", r"\blista[r]?\b.*\bdoc", r"\bnombres?\b.*\bdoc",
    r"\bdoc.*\bnombres?\b", r"\bmenciona[r]?\b.*\bdoc", r"\benumera[r]?\b.*\bdoc", r"\bqu[eé] doc", r"\bcu[aá]les?\b.*\bdoc", r"\bdame.*\bnombres?\b",
    r"\bwie viele? doc", r"\bwie viele? dok", r"\bwie viele?.{0,20}(?:datenbank|basis)\b", r"\banzahl (?:der |von )?doc", r"\banzahl (?:der |von )?dok",
    r"\b(?:datenbank|basis).{0,15}enth[aä]lt", r"\b(?:datenbank|basis).{0,15}hat", r"\bgr[oö][sß]e der (?:datenbank|basis)\b",
    r"\bstatistik(?:en)?\b.*\b(?:datenbank|basis)\b", r"\bdiese (?:datenbank|basis)\b.*\bwie viele?\b", r"\bliste[n]?\b.*\bdok", r"\bnamen?\b.*\bdok", r"\bdok.*\bnamen?\b",
    r"\bnenne[n]?\b.*\bdok", r"\baufz[aä]hl(?:en|e)?\b.*\bdok", r"\bwelche\b.*\bdok", r"\bwas f[uü]r\b.*\bdok", r"\bgib mir.*\bnamen?\b", r"\bzeig(?:e|en)?\b.*\bdok",
    r"\bhow many doc", r"\bdocument count\b", r"\bsize of (?:the )?(?:database|knowledge base)\b", r"\bstats?\b.*\b(?:database|knowledge base)\b",
    r"\btotal (?:de )?(?:documents?|fichiers?)\b", r"\btotal (?:documents?|files?)\b", r"\bnumber of doc", r"\blist\b.*\bdoc", r"\bnames?\b.*\bdoc", r"\bdoc.*\bnames?\b",
    r"\bwhat\b.*\bdoc", r"\bwhich\b.*\bdoc",
    r"\b(?:database|base|datenbank|basis)\b.*\b(?:size|taille|tama[ñn]o|gr[oö][sß]e|count|nombre|n[uú]mero|anzahl)\b",
    r"\b(?:count|nombre|n[uú]mero|anzahl)\b.*\b(?:database|base|datenbank|basis)\b",
)
# Questions that need an aggregation; French, English, Spanish, German.
AGGREGATION = (
    r"\bcombien\s+(?:de|d')", r"\bnombre\s+(?:de|d'|total)", r"\btotal\s+(?:de|d')", r"\bmoyenne\b", r"\bliste[rz]?\s+(?:tous|toutes|les)", r"\brépartition\b",
    r"\bstatistiques?\b", r"\bhow\s+many\b", r"\bcount\s+(?:of|the|all)\b", r"\baverage\b", r"\btotal\s+(?:of|number)\b", r"\blist\s+all\b", r"\bdistribution\b",
    r"\bbreakdown\b", r"\bcu[aá]ntos?\b", r"\bpromedio\b", r"\blistar\s+todos?\b", r"\bwie\s+viele?\b", r"\bdurchschnitt\b", r"\balle\s+auflisten\b",
)
# Words of demanding queries.
KEYWORDS = (
    r"\bpourquoi\b", r"\bwhy\b", r"\bcause[sd]?\b", r"\breason(?:s|ing)?\b", r"\bconséquence[s]?\b", r"\bconsequence[s]?\b", r"\bimpact[s]?\b", r"\beffet[s]?\b",
    r"\beffect[s]?\b", r"\banalyse[rz]?\b", r"\banalyz[es]?\b", r"\bévalue[rz]?\b", r"\bevaluat[es]?\b", r"\bexplique[rz]?\b", r"\bexplain\b", r"\bjustifi[ez]?\b",
    r"\bjustify\b", r"\bcompare[rz]?\b", r"\bcompare\b", r"\bdifférence[s]?\b", r"\bdifference[s]?\b", r"\bavantage[s]?\b", r"\badvantage[s]?\b",
    r"\binconvénient[s]?\b", r"\bdisadvantage[s]?\b", r"\bmeilleur[es]?\b", r"\bbetter\b", r"\bbest\b", r"\bétape[s]?\b", r"\bstep[s]?\b", r"\bprocessus\b",
    r"\bprocess\b", r"\bcomment .+ puis\b", r"\bfirst .+ then\b", r"\brésume[rz]?\b", r"\bsummariz[es]?\b", r"\bsynthèse\b", r"\bsynthesi[sz]e\b", r"\bvue d'ensemble\b",
    r"\boverview\b",
)
# Weights of the complexity factors, and the scores from which a query is complex or moderate.
COMPLEXITY_WEIGHTS = {"query_type": 0.25, "entity_count": 0.20, "subquestion_count": 0.20, "keyword_matches": 0.20, "low_confidence": 0.15}
AGENT_THRESHOLD, MODERATE_THRESHOLD = 0.55, 0.35
# Two entities named by a query, and queries about the whole collection.
RELATION_QUESTIONS = (
    r"relationship between (.+?) and (.+)", r"how (?:does|is) (.+?) (?:related|connected) to (.+)", r"what connects (.+?) (?:to|and) (.+)", r"path from (.+?) to (.+)",
)
GLOBAL_QUESTIONS = ("what are all", "list all", "summarize", "overview of", "main (?:topics|themes|concepts)")
# Parts of a text that speak for a language, and questions that count double.
INDICATORS = {
    "es": (
        " es ", " son ", " que ", " qué ", " cómo ", " cuánto ", " cuántos ", " dónde ", " quién ", " cuál ", " cuáles ", " por qué ", " para ", " los ", " las ", " una ",
        " del ", " esta ", " este ", " estos ", " tengo ", " tiene ", " tienen ", " puedo ", " puede ", " hay ", " está ", " están ", "¿", " muy ", " también ", " pero ",
        " porque ", " esto ", " eso ", " aquí ", " ahí ", " ahora ", " hacer ", " ser ", " como ", " cuando ", " donde ", " quien ", " cual ", "ícame ", "ácame ", "éame ",
        "íame ", "ámelo", "émelo", "ímelo", " documentos ", " datos ", " lista ", " archivo ",
    ),
    "de": (
        " ist ", " sind ", " das ", " der ", " die ", " den ", " dem ", " ein ", " eine ", " einer ", " und ", " oder ", " aber ", " nicht ", " auch ", " sehr ", " wie ",
        " was ", " wer ", " wo ", " wann ", " warum ", " welche ", " welcher ", " können ", " haben ", " werden ", " gibt ", " muss ", " kann ", " soll ", " wird ",
        " habe ", " hat ", "ß", "ä", "ö", "ü", " auf ", " aus ", " bei ", " mit ", " nach ", " von ", " zu ", " mir ", " dir ", " uns ", " euch ", " ihr ", " ihm ", " ihr ",
        " dokumente ", " datenbank ",
    ),
    "fr": (
        " est ", " sont ", " que ", " qui ", " dans ", " pour ", " avec ", " les ", " des ", " une ", " sur ", " pas ", " plus ", " cette ", " ces ", " vous ", " nous ",
        " leur ", " quoi ", " comment ", " pourquoi ", " combien ", " quand ", "qu'", "d'", "l'", "n'", "-tu ", "-vous ", "-moi ", "-elle ", "-il ", " je ", " tu ",
    ),
}
INDICATOR_QUESTIONS = {
    "es": ("¿qué", "¿cómo", "¿cuánto", "¿dónde", "¿por qué", "¿cuál"), "de": ("wie viele", "was ist", "wo ist", "warum", "welche"),
    "fr": ("est-ce", "qu'est", "combien", "pourquoi", "comment"),
}


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for all, word boundaries by Unicode."""
    return "(?U)" + "|".join(f"(?:{p})" for p in patterns)


def classify(query: Column) -> Column:
    """(query_type, confidence): by the first list with a match, else by the first word."""
    q = F.lower(strip(query))
    kind, confidence = None, None
    for name, patterns in QUERY_PATTERNS.items():
        hit = q.rlike(any_of(patterns))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        confidence = F.when(hit, 0.8) if confidence is None else confidence.when(hit, 0.8)
    for pattern, name, c in QUESTION_WORDS:
        kind, confidence = kind.when(q.rlike(any_of((pattern,))), name), confidence.when(q.rlike(any_of((pattern,))), c)
    return F.struct(kind.otherwise("unknown").alias("query_type"), confidence.otherwise(0.3).alias("confidence"))


def _by_type(query_type: Column, values: dict[str, object]) -> Column:
    out = F.lit(values["unknown"])
    for name, v in values.items():
        out = F.when(query_type == name, v).otherwise(out)
    return out


def route(query_type: Column, confidence: Column, n_entities: Column, skip_below: float = 0.15) -> Column:
    """(vector_weight, graph_weight, mode, skip_vector, skip_graph).

    A sure factual query goes to vectors alone, an exploratory one to the graph
    alone, and a relational one without entities to both alike.
    """
    v, g, m = (_by_type(query_type, {k: w[i] for k, w in WEIGHTS.items()}) for i in range(3))
    plain = (query_type == "factual") & (confidence > 0.7)
    whole = query_type == "exploratory"
    open_ = (query_type == "relational") & (n_entities == 0)
    return F.struct(
        F.when(plain, 1.0).when(whole, 0.0).when(open_, 0.5).otherwise(v).alias("vector_weight"),
        F.when(plain, 0.0).when(whole, 1.0).when(open_, 0.5).otherwise(g).alias("graph_weight"),
        F.when(plain, "vector_only").when(whole, "graph_only").otherwise(m).alias("mode"),
        (whole | (v < skip_below)).alias("skip_vector"),
        F.when(open_, False).otherwise(plain | (g < skip_below)).alias("skip_graph"),
    )


def override(strategy: str, decision: Column) -> Column:
    """(skip_vector, skip_graph) after the configured strategy: vector_only, graph_only, hybrid or auto."""
    v, g = decision["skip_vector"], decision["skip_graph"]
    if strategy == "vector_only":
        v, g = F.lit(False), F.lit(True)
    elif strategy == "graph_only":
        v, g = F.lit(True), F.lit(False)
    elif strategy == "hybrid":
        v, g = F.lit(False), F.lit(False)
    return F.struct(v.alias("skip_vector"), g.alias("skip_graph"))


def chat_weights(query_type: Column) -> Column:
    """(vector_weight, graph_weight) on the chat path, which never leaves vectors out."""
    v, g = (_by_type(query_type, {k: w[i] for k, w in WEIGHTS.items()}) for i in range(2))
    whole = query_type == "exploratory"
    return F.struct(F.when(whole, 0.3).otherwise(v).alias("vector_weight"), F.when(whole, 0.7).otherwise(g).alias("graph_weight"))


def fallback(vector_weight: Column, graph_weight: Column, skip_vector: Column, skip_graph: Column, vector_confidence: Column, graph_confidence: Column, threshold: float = 0.3) -> Column:
    """(vector_weight, graph_weight, adaptive) after shifting weight away from an arm of low confidence."""
    shift = lambda c: F.when(c < threshold, 0.3 * (1 - c / threshold)).otherwise(0.0)
    a = F.when(skip_graph, 0.0).otherwise(shift(vector_confidence))
    v1, g1 = F.greatest(F.lit(0.0), vector_weight - a), F.least(F.lit(1.0), graph_weight + a)
    b = F.when(skip_vector, 0.0).otherwise(shift(graph_confidence))
    return F.struct(
        F.least(F.lit(1.0), v1 + b).alias("vector_weight"),
        F.greatest(F.lit(0.0), g1 - b).alias("graph_weight"),
        ((vector_confidence < threshold) & (graph_confidence < threshold)).alias("adaptive"),
    )


def n_subquestions(text: Column) -> Column:
    """Bullets and numbered lines, one at least."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.greatest(F.lit(1), count(r"(?m)^\s*[-•*]\s+.+") + count(r"(?m)^\s*\d+[.)]\s+.+"))


def n_keywords(query: Column) -> Column:
    q = F.lower(query)
    total = F.lit(0)
    for p in KEYWORDS:
        total = total + q.rlike(any_of((p,))).cast("int")
    return total


def is_ambiguous(query: Column) -> Column:
    return F.lower(query).rlike(any_of(AMBIGUOUS))


def is_database_meta(query: Column) -> Column:
    return F.lower(query).rlike(any_of(DATABASE_META))


def is_aggregation(query: Column) -> Column:
    return F.lower(query).rlike(any_of(AGGREGATION))


def complexity(query: Column, query_type: Column, confidence: Column, n_entities: Column, rewritten: Column | None = None) -> Column:
    """(score, level): weighted factors, and the levels that a question's kind forces."""
    w = COMPLEXITY_WEIGHTS
    kind = F.when(query_type.isin("analytical", "comparative"), 1.0).when(query_type.isin("relational", "exploratory"), 0.5).otherwise(0.0)
    score = (
        w["query_type"] * kind
        + w["entity_count"] * F.least(n_entities / 4.0, F.lit(1.0))
        + w["subquestion_count"] * F.least((n_subquestions(rewritten if rewritten is not None else query) - 1) / 3.0, F.lit(1.0))
        + w["keyword_matches"] * F.least(n_keywords(query) / 3.0, F.lit(1.0))
        + w["low_confidence"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.7 - confidence) / 0.5))
    )
    meta, agg, vague = is_database_meta(query), is_aggregation(query), is_ambiguous(query)
    forced = F.when(meta, AGENT_THRESHOLD + 0.2).when(agg | vague, AGENT_THRESHOLD + 0.1)
    level = F.when(meta | agg, "complex").when(vague, "ambiguous").when(score >= AGENT_THRESHOLD, "complex").when(score >= MODERATE_THRESHOLD, "moderate").otherwise("simple")
    return F.struct(F.greatest(score, F.coalesce(forced, F.lit(0.0))).alias("score"), level.alias("level"))


def path_of(score: Column, top_k: int = 10) -> Column:
    """(path, top_k): agent, enhanced (half as many results again) or fast."""
    enhanced = (score >= MODERATE_THRESHOLD) & (score < AGENT_THRESHOLD)
    return F.struct(
        F.when(score >= AGENT_THRESHOLD, "agent").when(enhanced, "enhanced").otherwise("fast").alias("path"),
        F.when(enhanced, F.bround(F.lit(top_k * 1.5)).cast("int")).otherwise(top_k).alias("top_k"),
    )


def relation_question(query: Column) -> Column:
    """(source, target) of a query about two entities, nulls otherwise."""
    q = F.lower(query)
    source, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(RELATION_QUESTIONS):
        hit = q.rlike(p)
        source = F.when(hit, strip(F.regexp_extract(q, p, 1))).otherwise(source)
        target = F.when(hit, strip(F.regexp_extract(q, p, 2))).otherwise(target)
    return F.struct(source.alias("source"), target.alias("target"))


def is_global(query: Column) -> Column:
    return F.lower(query).rlike(any_of(GLOBAL_QUESTIONS))


def language_of_query(query: Column) -> Column:
    """es, de, fr by the most indicators (two at least, ties in this order), else en."""
    q = F.lower(query)
    n = {}
    for lang, parts in INDICATORS.items():
        total = F.lit(0)
        for p in parts:
            total = total + q.contains(p).cast("int")
        asked = F.lit(False)
        for p in INDICATOR_QUESTIONS[lang]:
            asked = asked | q.contains(p)
        n[lang] = total + F.when(asked, 2).otherwise(0)
    top = F.greatest(*n.values())
    return F.when(top < 2, "en").when(n["es"] == top, "es").when(n["de"] == top, "de").otherwise("fr")
