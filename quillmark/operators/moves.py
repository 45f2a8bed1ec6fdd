"""Rhetorical moves of sentences: segmentation, rules, reconciliation, blocks, flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import balanced
from quillmark.operators.citations import has_citation

# The default lexicon, written for this library after the published three-move
# model of research introductions: (taxonomy, move, label, step, weight, cues).
LEXICON = [
    ("introduction", "M1", "Establishing a territory", "Claiming centrality", 0.8, ["important", "central to", "widely", "increasing(ly)? interest", "plays a key role"]),
    ("introduction", "M1", "Establishing a territory", "Making generalizations", 0.7, ["generally", "it is known", "commonly", "often", "there is evidence"]),
    ("introduction", "M1", "Establishing a territory", "Reviewing previous research", 0.8, ["previous (studies|work|research)", "has been (shown|studied|reported)", "according to", "earlier (studies|work)"]),
    ("introduction", "M2", "Establishing a niche", "Indicating a gap", 0.9, ["however", "little is known", "remains? unclear", "lack of", "few studies", "has not been"]),
    ("introduction", "M2", "Establishing a niche", "Counter-claiming", 0.8, ["in contrast", "contrary to", "despite", "notwithstanding", "although"]),
    ("introduction", "M2", "Establishing a niche", "Raising a question", 0.7, ["why (was|is|do|does)", "whether", "question", "how (was|is|do|does)"]),
    ("introduction", "M3", "Occupying the niche", "Announcing the present work", 0.9, ["in this (paper|study|work)", "we (present|propose|report)", "the (aim|purpose) of", "this was shown"]),
    ("introduction", "M3", "Occupying the niche", "Outlining the structure", 0.8, ["is organi[sz]ed as follows", "section \\d", "the remainder of", "see sect"]),
    ("literature_review", "M1", "Setting the scope", "Defining concepts", 0.7, ["is defined as", "refers to", "concept of", "framework"]),
    ("literature_review", "M2", "Synthesizing sources", "Summarizing findings", 0.8, ["found that", "showed that", "reported", "results of", "described"]),
    ("literature_review", "M2", "Synthesizing sources", "Comparing studies", 0.8, ["in contrast", "similarly", "whereas", "compared (to|with)", "on the other hand"]),
    ("literature_review", "M3", "Positioning the study", "Identifying limits", 0.8, ["limitation", "however", "overlooked", "not (yet )?(been )?addressed", "left out"]),
    ("discussion", "M1", "Reporting results", "Restating findings", 0.8, ["we found", "the results (show|suggest|indicate)", "our (findings|results)", "rose by", "fell to"]),
    ("discussion", "M2", "Commenting on results", "Comparing with literature", 0.8, ["consistent with", "in line with", "in agreement", "contrary to", "cf\\."]),
    ("discussion", "M2", "Commenting on results", "Explaining results", 0.7, ["may be due to", "because", "can be explained", "suggests? that", "likely"]),
    ("discussion", "M3", "Concluding", "Stating limits and implications", 0.8, ["limitation", "future (work|research|studies)", "implications?", "in conclusion", "further research"]),
]
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("et al", "e.g", "i.e", "etc", "vs", "cf", "Fig", "Figs", "Tab", "Eq", "Eqs", "Ref", "Refs", "Dr", "Mr", "Mrs", "Ms", "Prof", "Jr", "Sr", "Vol", "No", "pp", "ca", "approx", "Sect", "St")


def split_sentences(text: Column) -> Column:
    """Pieces after a terminator, white space and a capital, digit, quote or bracket;
    abbreviations and decimals are kept whole."""
    t = F.regexp_replace(text, r"\s+", " ")
    for a in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"(?<![\p{{L}}]){a.replace('.', '[.]')}\.", a.replace(".", "\u0001") + "\u0001")
    t = F.regexp_replace(t, r"(\d)\.(\d)", "$1\u0001$2")
    pieces = F.split(t, r"(?<=[.!?])\s+(?=[A-Z\"“'(])", -1)
    return F.transform(pieces, lambda p: F.trim(F.translate(p, "\u0001", ".")))


def segment(sections: DataFrame, least: int = 15) -> DataFrame:
    """(doc_id, section, section_ord, sentence_id, text, position_pct): sentences of
    at least ``least`` characters, numbered through the document, with their relative
    place in the section (50 for a single one)."""
    clean = F.regexp_replace("text", r"(?m)^#+\s.*$", "")
    rows = sections.where(F.length(F.trim("text")) >= 10).select("doc_id", "section_ord", "section", F.posexplode(split_sentences(clean)).alias("i", "text")).where(F.length("text") >= least)
    w = Window.partitionBy("doc_id", "section_ord")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("i"))
    pct = F.when(n == 1, 50.0).otherwise(F.round((k - 1) / (n - 1) * 100, 1))
    return rows.withColumn("sentence_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_ord", "i"))).withColumn("position_pct", pct).drop("i")


def taxonomy(section: Column) -> Column:
    """Taxonomy of a section's name; null for methods, introduction by default."""
    s = F.lower(section)
    return (
        F.when(s.rlike(r"introduction|\bintro\b"), "introduction")
        .when(s.rlike("literature|related work|background|state of the art|theoretical framework|review"), "literature_review")
        .when(s.rlike("discussion|conclusion|implication|closing remarks"), "discussion")
        .when(s.rlike("method|material|experimental|procedure|design|data collection"), F.lit(None))
        .otherwise("introduction")
    )


def position_bonus(move: str, tax: str, pct: Column) -> Column:
    # Fixed values: (above, up to, bonus) by taxonomy and move.
    ranges = {
        ("introduction", "M1"): (-1, 40, 0.15), ("introduction", "M2"): (30, 70, 0.15), ("introduction", "M3"): (60, 1000, 0.20),
        ("discussion", "M1"): (-1, 50, 0.15), ("discussion", "M2"): (40, 80, 0.10), ("discussion", "M3"): (60, 1000, 0.20),
        ("literature_review", "M1"): (-1, 30, 0.15), ("literature_review", "M3"): (70, 1000, 0.15),
    }
    low, high, bonus = ranges.get((tax, move), (0, 0, 0.0))
    return F.when((pct > low) & (pct <= high), bonus).otherwise(0.0)


def rule_based(sentences: DataFrame, lexicon=None) -> DataFrame:
    """move_rule, step_rule and conf_rule of each sentence of a taxonomy.

    A step scores half its weight per matching cue (1 at most), plus bonuses for
    place and citations; the first step of the highest score wins. One balanced
    sum per step keeps the expression flat.
    """
    low, cited = F.lower(F.col("text")), has_citation(F.col("text"))
    rows = sentences.withColumn("taxonomy_type", taxonomy(F.col("section"))).withColumn("_low", low).withColumn("_cited", cited)
    by_tax = {}
    for order, (tax, move, label, step, weight, cues) in enumerate(lexicon or LEXICON):
        hits = balanced([F.col("_low").rlike(c).cast("int") for c in cues])
        extra = F.when(F.col("_cited"), 0.15).otherwise(0.0) if any(w in step for w in ("Reviewing", "Summarizing", "Comparing")) else F.lit(0.0)
        score = F.least(F.lit(1.0), F.least(F.lit(1.0), hits * weight * 0.5) + position_bonus(move, tax, F.col("position_pct")) + extra)
        by_tax.setdefault(tax, []).append(F.struct(F.when(hits > 0, score).otherwise(0.0).alias("score"), F.lit(-order).alias("o"), F.lit(f"{move}: {label}").alias("move"), F.lit(step).alias("step")))
    best = None
    for tax, steps in by_tax.items():
        own = F.array_max(F.array(*steps))
        best = F.when(F.col("taxonomy_type") == tax, own) if best is None else best.when(F.col("taxonomy_type") == tax, own)
    out = rows.withColumn("_best", best)
    hit = F.col("_best.score") > 0
    return out.withColumn("move_rule", F.when(hit, F.col("_best.move"))).withColumn("step_rule", F.when(hit, F.col("_best.step"))).withColumn("conf_rule", F.when(hit, F.round("_best.score", 3)).otherwise(0.0)).drop("_best", "_low", "_cited")


def reconcile(df: DataFrame) -> DataFrame:
    """move, step, confidence and method from the rules' and the model's labels."""
    rule, llm = F.col("move_rule").isNotNull(), F.col("move_llm").isNotNull()
    agree = rule & llm & (F.col("move_rule") == F.col("move_llm"))
    out = df.withColumn("move", F.when(llm, F.col("move_llm")).when(rule, F.col("move_rule")).otherwise("Unclassified"))
    out = out.withColumn("step", F.when(llm, F.col("step_llm")).when(rule, F.col("step_rule")))
    conf = F.when(agree, F.least(F.lit(1.0), (F.col("conf_rule") + F.col("conf_llm")) / 2 + 0.15)).when(rule & llm, F.col("conf_llm") * 0.85).when(llm, F.col("conf_llm")).when(rule, F.col("conf_rule")).otherwise(0.0)
    method = F.when(agree, "rule+llm").when(llm, "llm").when(rule, "rule").otherwise("none")
    return out.withColumn("confidence", F.round(conf, 3)).withColumn("method", method)


def move_label(code: Column, tax: Column, lexicon=None) -> Column:
    """'M1: label' of a move's code in a taxonomy; the code itself where it has none."""
    labels = {(t, m): label for t, m, label, *_ in lexicon or LEXICON}
    known = F.create_map(*[F.lit(x) for (t, m), label in labels.items() for x in (f"{t}/{m}", label)])
    return F.concat(code, F.lit(": "), F.coalesce(F.element_at(known, F.concat_ws("/", tax, code)), code))


# Sections whose moves are not analysed.
NOT_ANALYSED = r"(?i)(results|findings|references|appendix|acknowledg|bibliography|full_text|preface|preamble|method|material|experimental|procedure)"


def analysed_sections(sections: DataFrame) -> DataFrame:
    return sections.where(~F.col("section").rlike(NOT_ANALYSED))


def batches(sentences: DataFrame, size: int = 20, keys: list[str] | None = None) -> DataFrame:
    """Sentences numbered within batches of ``size`` of one document and taxonomy:
    batch and id columns. A batch goes to a model as one prompt."""
    keys = ["doc_id", "taxonomy_type"] if keys is None else keys
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("sentence_id"))
    numbered = sentences.where(F.col("taxonomy_type").isNotNull()).withColumn("_k", k)
    return numbered.withColumn("batch", F.ceil(F.col("_k") / size).cast("int")).withColumn("id", ((F.col("_k") - 1) % size + 1).cast("int")).drop("_k")


def prompts(batched: DataFrame, keys: list[str] | None = None, lexicon=None) -> DataFrame:
    """(keys, batch, n_sentences, prompt): the taxonomy and the numbered sentences of each batch."""
    keys = ["doc_id", "taxonomy_type"] if keys is None else keys
    told: dict[str, list[str]] = {}
    for tax, move, label, step, *_ in lexicon or LEXICON:
        lines = told.setdefault(tax, [])
        if f"{move}: {label}" not in lines:
            lines.append(f"{move}: {label}")
        lines.append(f"  - {step}")
    known = F.create_map(*[F.lit(x) for tax, lines in told.items() for x in (tax, "\n".join(lines))])
    sentence = F.concat(F.col("id").cast("string"), F.lit(". "), F.col("text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", sentence.alias("s")))), lambda x: x["s"]), "\n")
    out = batched.groupBy(*keys, "batch").agg(F.count("*").alias("n_sentences"), listed.alias("listed"))
    ask = F.concat(F.lit(PROMPT_HEAD), F.element_at(known, F.col("taxonomy_type")), F.lit("\n\n"), F.col("listed"), F.lit(PROMPT_TAIL))
    return out.select(*keys, "batch", "n_sentences", ask.alias("prompt"))


PROMPT_HEAD = "Label each numbered sentence of a scientific paper with its rhetorical move and step. Moves and steps:\n"
PROMPT_TAIL = "\n\nAnswer with a JSON array only, one object for each sentence: id, move (its code), step, confidence between 0 and 1."


def with_answers(batched: DataFrame, answers: DataFrame, keys: list[str] | None = None, lexicon=None) -> DataFrame:
    """Sentences with a model's labels (move_llm, step_llm, conf_llm) from parsed answers
    (keys, batch, id, move, step, confidence); of several for one sentence the first by
    move and step."""
    keys = ["doc_id", "taxonomy_type"] if keys is None else keys
    one = answers.groupBy(*keys, "batch", "id").agg(F.min(F.struct("move", "step", "confidence")).alias("x"))
    out = batched.join(one, [*keys, "batch", "id"], "left")
    return out.withColumn("move_llm", F.when(F.col("x").isNotNull(), move_label(F.col("x.move"), F.col("taxonomy_type"), lexicon))).withColumn("step_llm", F.col("x.step")).withColumn("conf_llm", F.coalesce("x.confidence", F.lit(0.0))).drop("x")


def classify(sections: DataFrame, answers: DataFrame | None = None, batch_size: int = 20, lexicon=None) -> dict[str, DataFrame]:
    """The whole analysis of sections (doc_id, section_ord, section, text): sentences with
    move, step, confidence and method, their blocks, distributions, flow and methods.

    ``answers`` are parsed answers to :func:`prompts`; without them the rules decide.
    """
    own = segment(analysed_sections(sections)).withColumn("taxonomy_type", taxonomy(F.col("section"))).where(F.col("taxonomy_type").isNotNull())
    ruled = batches(rule_based(own, lexicon), batch_size)
    none = F.lit(None).cast("string")
    told = with_answers(ruled, answers, lexicon=lexicon) if answers is not None else ruled.withColumns({"move_llm": none, "step_llm": none, "conf_llm": F.lit(0.0)})
    out = reconcile(told).select("doc_id", "sentence_id", "section", "text", "position_pct", "move", "step", "confidence", "method")
    keys = ["doc_id", "section"]
    return {
        "sentences": out, "blocks": blocks(out, keys, "sentence_id"), "moves": distribution(out, keys, ["move"]), "steps": distribution(out, keys, ["move", "step"]),
        "flow": flow(out, keys, "sentence_id"), "methods": out.groupBy("doc_id", "method").agg(F.count("*").alias("n")),
    }


def parse_responses(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, move, step, confidence; the key is batch_id by default) from a model's JSON answers, fenced or
    not; errors and malformed answers give no rows, confidences are clamped."""
    body = F.regexp_extract("response", r"(?s)(\[.*\])", 1)
    items = F.from_json(F.when(~F.col("response").startswith("ERROR:"), body), "array<struct<id:int,move:string,step:string,confidence:double>>")
    keys = ["batch_id"] if keys is None else keys
    rows = responses.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*").where(F.col("id").isNotNull() & F.col("move").isNotNull())
    return rows.withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def blocks(sentences: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs of sentences of one section with the same move and step."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.col("move").eqNullSafe(F.lag("move").over(w)) & F.col("step").eqNullSafe(F.lag("step").over(w)) & F.lag(order).over(w).isNotNull()
    runs = sentences.withColumn("_new", (~same).cast("int")).withColumn("block", F.sum("_new").over(w))
    return runs.groupBy(*keys, "block").agg(F.first("move").alias("move"), F.first("step").alias("step"), F.min(order).alias("first_sentence"), F.max(order).alias("last_sentence"), F.count("*").alias("n_sentences"), F.round(F.avg("confidence") + 1e-9, 3).alias("avg_confidence"))


def distribution(sentences: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Sentences by move (and step) with their percentage of the group."""
    n = sentences.groupBy(*keys, *by).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) * 100, 1))


def flow(sentences: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The order of moves of each group, repeats collapsed: 'A -> B -> A'."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = sentences.withColumn("_p", F.lag("move").over(w)).withColumn("_first", F.lag(order).over(w).isNull()).where(F.col("_first") | ~F.col("move").eqNullSafe(F.col("_p")))
    named = changed.select(*keys, F.struct(F.col(order).alias("o"), F.coalesce("move", F.lit("Unclassified")).alias("m")).alias("x"))
    return named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]), " -> ").alias("flow_pattern"))
