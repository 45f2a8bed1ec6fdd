"""Linking the spellings under which people and organisations were typed.

Merge and rematch: names with the same signature are one profile; profiles share
a block when their spellings do up to one slip; within a block every profile is
tied to the block's leading profile of the same given name, those it refuses to the
next leader (never pair by pair). Merged profiles union their spellings, given names
and initials and enter the blocks again, with all that stand there, until a round
merges nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.shared import written

# Fixed values --------------------------------------------------------------------
NICKNAMES = {
    "alexander": "alex sandy sasha xander", "antonio": "toni tonio tony", "charlotte": "charlie lottie", "christopher": "chris kester topher kit", "dorothea": "dora thea dorrie",
    "edward": "ned ed eddie ted", "elizabeth": "beth betty bess liz lizzie eliza", "francisco": "paco pancho chico", "frederik": "fred freddie rik", "gabriela": "gabi", "giuseppe": "peppe beppe",
    "henry": "hal harry hank", "isabella": "bella izzy isa", "johannes": "hans jo", "josephine": "josie jo", "katherine": "kit kathy kate katie", "leonard": "leo len lenny", "margaret": "meg peggy maggie greta",
    "matilda": "mattie tilda", "nicholas": "nick klaus nico", "oliver": "olli ollie", "patricia": "pat trish patty", "quentin": "quin", "richard": "dick rick ricky", "robert": "rob bob bobby", "susanna": "sue suzy",
    "theodore": "ted theo teddy", "ulrike": "uli", "veronica": "ronnie vera", "william": "bill will liam billy", "yolanda": "yola", "zacharias": "zach zak",
}
PARTICLES = frozenset("de la del der den van von di da du le ten ter".split())
SUFFIX = re.compile(r"(?:,?\s*(?:\(eds?\.?\)|\bjr\b\.?|\bsr\b\.?|\bph\.?\s?d\b\.?|\bm\.?d\b\.$|\biii?\b))+\s*$", re.I)
ORGANISATION = {
    "inst": "institute", "ins": "institute", "assoc": "association", "ass": "association", "cen": "centre", "com": "commission", "labor": "laboratory", "lab": "laboratory", "center": "centre", "ctr": "centre", "comm": "commission", "univ": "university", "soc": "society", "sci": "science", "text": "textile", "hist": "history", "med": "medicine",
    "eng": "engineering", "numer": "numerical", "cartogr": "cartography", "appl": "applied", "acoust": "acoustics", "technol": "technology", "biol": "biology", "stud": "studies", "res": "research",
}
ORG_WORDS = frozenset("institute association laboratory centre commission university society academy department council agency ministry committee group consortium".split())
NO_WORDS = frozenset("the of for and on in".split())
FOLD = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d"})
# ---------------------------------------------------------------------------------
#: Formal names of each nickname; some have several.
FORMALS = {n: tuple(k for k, v in NICKNAMES.items() if n in v.split()) for v in NICKNAMES.values() for n in v.split()} | {k: (k,) for k in NICKNAMES}
#: A word is a given name where at least so many rows have it as such; most such words kept.
GIVEN_ROWS, GIVEN_WORDS = 5, 5_000


def plain(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(FOLD)) if not unicodedata.combining(c))


def slips(word: str) -> set[str]:
    """The word and all words with one letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Given:
    """Given names: formal ones for nicknames and for slips of frequent names."""

    def __init__(self, frequent: list[str]):
        self.known = (set(frequent) | set(FORMALS)) - PARTICLES
        self.by_slip: dict[str, str] = {}
        for name in sorted(self.known):
            if len(name) > 4:
                for s in slips(name):
                    self.by_slip.setdefault(s, name)

    def formal(self, word: str) -> tuple[str, ...]:
        """Formal names that a word may stand for, maybe mistyped; none where it is no given name."""
        if word in self.known:
            return FORMALS.get(word, (word,))
        if len(word) > 4:
            for s in slips(word):
                hit = self.by_slip.get(s)
                if hit and abs(len(hit) - len(word)) <= 1:
                    return FORMALS.get(hit, (hit,))
        return ()


def _initials(part: str) -> list[str] | None:
    """Letters of a part that is initials only ('J. B.', 'JB', 'J'), else None."""
    s = part.strip()
    if re.fullmatch(r"(?:[^\W\d_]\.?[\s-]*){1,3}", s) and (("." in s) or s.upper() == s or len(s) == 1):
        return [plain(c) for c in re.findall(r"[^\W\d_]", s)]
    return None


def given_parts(text: str, given: Given) -> tuple[str, list[str]]:
    """(formal given name or '', initials) of a given-name part; a nickname of several
    names has no formal one, but the initials of each."""
    initials = _initials(text)
    if initials is not None and len(initials) <= 3:
        return "", ["".join(initials)]
    words = [plain(w) for w in re.findall(r"[^\W\d_]+", text)]
    if not words:
        return "", [""]
    first, middle = words[0], "".join(w[0] for w in words[1:])
    if len(first) == 1:
        return "", [first + middle]
    formal = given.formal(first) or (first,)
    return formal[0] if len(formal) == 1 else "", sorted({f[0] + middle for f in formal})


def family_spellings(text: str) -> list[str]:
    """Spellings of a family name: all letters, without particles, and the longer
    halves of a double name."""
    words = [w for w in re.findall(r"[^\W\d_]+", plain(text))]
    whole = "".join(words)
    core = [w for w in words if w not in PARTICLES] or words
    out = {whole, "".join(core)}
    if len(core) > 1:
        out |= {core[0]} if len(core[0]) >= 6 else set()
    return sorted(x for x in out if x)


def organisation(text: str) -> str | None:
    """Sorted full words of an organisation's name, None for a person."""
    words = [ORGANISATION.get(w, w) for w in re.findall(r"[^\W\d_]+", plain(text))]
    if not ORG_WORDS & set(words):
        return None
    return " ".join(sorted(w for w in words if w not in NO_WORDS))


def parse(family: str | None, name: str | None, given: Given) -> tuple[list[str], str, list[str]] | None:
    """(spellings, formal given name, initials) of a typed name; None if there is none.

    An organisation has the given name '#'.
    """
    family, name = SUFFIX.sub("", (family or "").strip()), SUFFIX.sub("", (name or "").strip())
    if not family and not name:
        return None
    org = organisation(family if not name else f"{name} {family}")
    if org:
        return [org], "#", ["#"]
    if not name and "," in family:
        family, name = (x.strip() for x in family.split(",", 1))
    elif not name:
        words = family.split()
        if len(words) > 1:
            n = 1
            while n < len(words) - 1 and _initials(words[n]) is not None and plain(words[n]) not in PARTICLES:
                n += 1
            tail = words[-1]
            if _initials(tail) is not None and tail.upper() == tail and len(tail.replace(".", "")) <= 3 and _initials(words[0]) is None:
                name, family = tail, " ".join(words[:-1])  # 'Family AB'
            elif plain(words[0]) not in PARTICLES:
                name, family = " ".join(words[:n]), " ".join(words[n:])
    elif family and name:
        head = [w for w in re.findall(r"[^\W\d_]+", plain(family)) if w not in PARTICLES]
        own = [w for w in re.findall(r"[^\W\d_]+", plain(name)) if w not in PARTICLES]
        a_given = bool(head) and all(len(w) == 1 for w in head[1:]) and (head[0] in given.known or bool(given.formal(head[0])) and not (own and given.formal(own[0])))
        if (_initials(family) is not None or a_given) and _initials(name) is None and not (own and own[0] in given.known):
            family, name = name, family
    spellings = family_spellings(family)
    if not spellings:
        return None
    formal, initials = given_parts(name, given)
    return spellings, formal, initials


def first_author(authors: str) -> str:
    """The first name of a list of authors, as 'Family, Given', 'G. Family' or 'Family G'."""
    s = re.sub(r"[,\s]*\bet\s+al\.?.*$", "", authors.strip(), flags=re.I)
    s = re.split(r";|\s&\s|\band\b", s)[0].strip()
    if organisation(s.split(",")[0]):
        parts = [p.strip() for p in s.split(",")]
        return f"{parts[0]} {parts[1]}" if len(parts) > 1 and not ORG_WORDS & set(re.findall(r"\w+", plain(parts[0]))) else parts[0]
    parts = [p.strip() for p in s.split(",") if p.strip()]
    if len(parts) < 2:
        return s
    if len(parts) > 1 and organisation(parts[0] + " " + parts[1]) and _initials(parts[1]) is None and len(parts[1].split()) == 1:
        return f"{parts[0]} {parts[1]}"
    words = parts[0].split()
    if len(words) > 1 and (_initials(words[0]) is not None and plain(words[0]) not in PARTICLES or _initials(words[-1]) is not None and words[-1].upper() == words[-1] and plain(words[0]) not in PARTICLES or _initials(words[-1]) is not None and len(words[-1].replace(".", "")) <= 2 and words[-1].isupper()):
        return parts[0]
    return f"{parts[0]}, {parts[1]}"


def typed_names(authors: DataFrame, citations: DataFrame) -> DataFrame:
    """(rec_id, is_author, family, given, orcid) of the records that name someone; equal rows once.

    A citation counts where it has ``ref_authors``; rows without any name do not.
    """
    orcid = F.regexp_extract(F.upper("orcid"), r"(\d{4}-?\d{4}-?\d{4}-?\d{3}[\dX])\s*$", 1)
    a = authors.select(F.col("author_id").alias("rec_id"), F.lit(True).alias("is_author"), F.col("family_name").alias("family"), F.col("given_name").alias("given"), F.when(F.length(orcid) > 0, F.regexp_replace(orcid, "-", "")).alias("orcid"))
    c = citations.where(F.length(F.trim("ref_authors")) > 0).select(F.col("mapping_id").alias("rec_id"), F.lit(False).alias("is_author"), F.concat_ws("\t", F.lit(""), F.col("ref_authors"), F.col("cite_author")).alias("family"), F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("orcid"))
    return a.unionByName(c).where(F.length(F.trim(F.coalesce("family", "given"))) > 0).distinct()


def frequent_given(authors: DataFrame) -> list[str]:
    """Words that stand as given names in many rows (a bounded list)."""
    word = F.lower(F.regexp_extract(F.trim("given_name"), r"^(\p{L}{2,})", 1))
    as_family = authors.select(F.lower(F.trim("family_name")).alias("w")).groupBy("w").agg(F.count("*").alias("m"))
    rows = authors.select(word.alias("w")).where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= GIVEN_ROWS).join(as_family, "w", "left").where(F.col("n") > F.coalesce("m", F.lit(0))).orderBy(F.desc("n"), "w").limit(GIVEN_WORDS)
    return [plain(r["w"]) for r in rows.collect()]


def signatures(names: DataFrame, given_words: list[str]) -> DataFrame:
    """(family, given, spellings, formal, initials; several between bars) of every distinct typed name."""
    forms = names.select("family", "given").distinct()
    shipped = names.sparkSession.sparkContext.broadcast(given_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Given(shipped.value)
        for batch in batches:
            rows = []
            for family, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, cited = family, None
                if family is not None and family.startswith("\t"):
                    _, text, *rest = family.split("\t")
                    text, cited = first_author(text), (rest[0] if rest else None)
                parsed = parse(text, name, given)
                if parsed and cited and parsed[1] != "#" and organisation(cited) is None:
                    # the citation's own spelling of the family name
                    parsed = (sorted({*parsed[0], *family_spellings(cited)}), *parsed[1:])
                if parsed:
                    rows.append((family, name, parsed[0], parsed[1], "|".join(parsed[2])))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["family", "given", "spellings", "formal", "initials"])

    return forms.mapInArrow(run, "family string, given string, spellings array<string>, formal string, initials string")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(a, root): the smallest member of each node's component, for nodes of (a, b).

    Each round hooks every root to the smallest root among its neighbours' and
    then follows pointers; both are joins on tables in the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), label)
    roots = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), label)
    while True:
        near = both.join(roots.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = roots.join(near, "a").select("a", "root", F.least("root", "r").alias("new"))
        # a root takes the smallest label any of its members saw
        lower = hooked.groupBy("root").agg(F.min("new").alias("low"))
        jumped = hooked.join(lower, "root").select("a", F.col("root").alias("old"), F.least("new", "low").alias("root"))
        after = written(jumped, label)
        changed = after.where("old <> root").limit(1).count()
        roots = after.select("a", "root")
        if not changed:
            return roots


def _one_slip(a, b):
    """Two spellings within one slip: a letter more, less or other, or two exchanged."""
    same = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    d = F.levenshtein(a, b, 2)
    return (d >= 0) & ((d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (same(a) == same(b))))


def _any_slip(a: str, b: str):
    """Whether any two spellings of two arrays are within one slip."""
    return F.exists(a, lambda x: F.exists(b, lambda y: _one_slip(x, y)))


def blocks(profiles: DataFrame) -> DataFrame:
    """(pid, s, h): the blocks of each spelling of a profile: the spelling, with at most
    one letter left out (short ones only as they are), and a first initial."""
    spelled = profiles.select("pid", "initials", F.explode("spellings").alias("s"))
    left_out = F.when(F.length("s") >= 5, F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.concat(F.col("s").substr(F.lit(1), i - 1), F.col("s").substr(i + 1, F.length("s"))))).otherwise(F.array().cast("array<string>"))
    firsts = F.filter(F.array_distinct(F.transform("initials", lambda i: F.substring(i, 1, 1))), lambda i: F.length(i) > 0)
    told = spelled.select("pid", "s", F.array_distinct(F.concat(F.array("s"), left_out)).alias("keys"), F.explode(firsts).alias("first"))
    return told.select("pid", "s", "first", F.explode("keys").alias("key")).select("pid", "s", F.xxhash64("key", "first").alias("h"))


def _led(rows: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): members (pid, n, spelled) of each group tied to the group's largest one,
    those without a spelling within a slip of one of its to the largest among
    themselves, and so on until all are tied or alone."""
    out, left = None, rows
    while True:
        leaders = left.groupBy(*by).agg(F.max(F.struct("n", "pid", "spelled")).alias("lead"))
        both = left.join(leaders, by).where(F.col("pid") != F.col("lead.pid")).withColumns({"b": F.col("lead.pid"), "t": F.col("lead.spelled")})
        told = written(both.select(*by, "pid", "n", "spelled", "b", _any_slip("spelled", "t").alias("tied")), "name-led")
        tied = told.where("tied").select(F.col("pid").alias("a"), "b")
        out = tied if out is None else out.unionByName(tied)
        left = told.where("not tied").select(*by, "pid", "n", "spelled")
        if not left.limit(1).count():
            return out.distinct()


def round_edges(rows: DataFrame) -> DataFrame:
    """(a, b): profiles to merge, each with a leader of its block.

    ``rows``: (pid, n, formals, initials, spelled, h), the members of blocks with
    their spellings there. In a block, profiles with the same formal given name follow
    the largest of them; profiles of initials only follow the one formal name there
    that agrees with their initials; where several do or none, those with equal
    initials follow their largest.
    """
    named = rows.where(F.size("formals") > 0).select("pid", "n", "spelled", "h", "initials", F.explode("formals").alias("formal"))
    bare = rows.where(F.size("formals") == 0).select("pid", "n", "spelled", "h", "initials")
    leaders = named.groupBy("h", "formal").agg(F.max(F.struct("n", "pid", "spelled")).alias("lead"), F.array_distinct(F.flatten(F.collect_set("initials"))).alias("all_initials"))
    # only blocks that have a bare member
    per_block = leaders.join(bare.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.collect_list(F.struct("lead", "all_initials")).alias("leaders"))
    # the middle initial must not contradict
    agrees = lambda mine, theirs: F.exists(mine, lambda m: F.exists(theirs, lambda t: m.startswith(t) | t.startswith(m)))
    # a merged profile may lead by several given names, it is one
    fits = F.array_distinct(F.transform(F.filter(F.coalesce("leaders", F.expr("array()")), lambda x: agrees(F.col("initials"), x["all_initials"])), lambda x: F.struct(x["lead"]["pid"].alias("pid"), x["lead"]["spelled"].alias("t"))))
    fitting = written(bare.join(per_block, "h", "left").select("pid", "n", "spelled", "h", "initials", fits.alias("fits")), "name-bare")
    alone = fitting.where(F.size("fits") == 1).select(F.col("pid").alias("a"), "spelled", F.get("fits", F.lit(0))["pid"].alias("b"), F.get("fits", F.lit(0))["t"].alias("t")).where("a <> b").where(_any_slip("spelled", "t")).select("a", "b")
    peers = _led(fitting.where(F.size("fits") != 1).select("pid", "n", "spelled", "h", F.explode("initials").alias("i")), ["h", "i"])
    return _led(named.select("pid", "n", "spelled", "h", "formal"), ["h", "formal"]).unionByName(alone).unionByName(peers).distinct()


def merged(profiles: DataFrame, roots: DataFrame) -> DataFrame:
    """Profiles after a round: unions of spellings, given names and initials."""
    tied = profiles.join(roots.withColumnRenamed("a", "pid"), "pid", "left").withColumn("pid", F.coalesce("root", "pid"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return tied.groupBy("pid").agg(union("spellings"), union("formals"), union("initials"), F.sum("n").alias("n"))


def entities(authors: DataFrame, citations: DataFrame) -> DataFrame:
    """(rec_id, is_author, entity) of every record that names someone.

    Records without a usable name are left out. Equal rows are one record; ties
    for a block's leader go to the larger number of rows, then the larger id.
    Rounds end when one merges nothing, which they do, as each merge leaves fewer
    profiles. After the first, only blocks that a merged profile enters are looked at.
    """
    names = written(typed_names(authors, citations), "names")
    forms = signatures(names, frequent_given(authors))
    # equal signatures are one profile from the start
    first = F.array_join("spellings", "|")
    pid = F.xxhash64(first, "formal", "initials")
    keyed = written(forms.select("family", "given", "spellings", "formal", "initials", pid.alias("pid")), "name-forms")
    records = written(names.join(keyed.select("family", "given", "pid"), (names["family"].eqNullSafe(keyed["family"])) & (names["given"].eqNullSafe(keyed["given"]))).select("rec_id", "is_author", "orcid", "pid"), "name-records")
    counts = records.groupBy("pid").agg(F.count("*").alias("n"))
    formals = F.when(F.length("formal") > 0, F.array("formal")).otherwise(F.array().cast("array<string>"))
    profiles = written(keyed.select("pid", "spellings", formals.alias("formals"), F.split("initials", r"\|").alias("initials")).dropDuplicates(["pid"]).join(counts, "pid"), "name-profiles")
    own = written(profiles.select(F.col("pid").alias("form"), "pid"), "name-members")
    # one identifier, one person
    holders = records.where(F.col("orcid").isNotNull()).select("orcid", "pid").distinct()
    edges = written(holders.join(holders.groupBy("orcid").agg(F.min("pid").alias("b")), "orcid").select(F.col("pid").alias("a"), "b").where("a <> b"), "name-edges")
    at_first = None  # the blocks of all profiles before any round
    while True:
        changed = None
        if edges.limit(1).count():
            roots = components(edges, "name-roots")
            profiles = written(merged(profiles, roots), "name-profiles")
            own = written(own.join(roots.withColumnRenamed("a", "pid"), "pid", "left").select("form", F.coalesce("root", "pid").alias("pid")), "name-members")
            changed = roots.select(F.col("root").alias("pid")).distinct()
        elif at_first is not None:
            break
        if at_first is None:
            at_first = written(blocks(profiles).withColumnRenamed("pid", "form"), "name-blocks")
            entered = at_first.withColumnRenamed("form", "pid")
        else:
            new = written(blocks(profiles.join(changed, "pid")), "name-new-blocks")
            touched = new.select("h").distinct()
            # what stood there, under its present profile
            stood = at_first.join(touched, "h", "left_semi").join(own, "form").select("pid", "s", "h")
            entered = written(stood.unionByName(new), "name-entered")
        # a block of one profile ties nothing
        crowded = entered.groupBy("h").agg(F.min("pid").alias("x"), F.max("pid").alias("y")).where("x <> y").select("h")
        there = entered.join(crowded, "h", "left_semi").groupBy("pid", "h").agg(F.array_sort(F.collect_set("s")).alias("spelled"))
        rows = written(there.join(profiles.select("pid", "n", "formals", "initials"), "pid"), "name-rows")
        edges = written(round_edges(rows), "name-edges")
    return records.join(own.withColumnRenamed("pid", "entity"), records["pid"] == own["form"]).select("rec_id", "is_author", "entity").distinct()


def sizes(found: DataFrame) -> DataFrame:
    """``found`` with the number of links of each record: to the other author records of
    its entity, and from these to its citation records."""
    n = found.groupBy("entity").agg(F.sum(F.col("is_author").cast("bigint")).alias("a"), F.sum((~F.col("is_author")).cast("bigint")).alias("c"))
    linked_ = F.when(F.col("is_author"), F.col("a") - 1 + F.col("c")).otherwise(F.col("a"))
    return found.join(n, "entity").select("rec_id", "is_author", "entity", linked_.alias("n_links"))


def linked(found: DataFrame) -> DataFrame:
    """(rec_a, rec_b): author records of one entity, and its author and citation records."""
    a = found.where("is_author").select(F.col("rec_id").alias("x"), "entity")
    b = found.select(F.col("rec_id").alias("y"), "is_author", "entity")
    pairs = a.join(b, "entity").where((F.col("x") < F.col("y")) | (~F.col("is_author") & (F.col("x") != F.col("y"))))
    return pairs.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()
