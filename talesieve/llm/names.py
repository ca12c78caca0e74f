"""Variant spellings of names typed by people, linked within a scope.

A spelling is cut into tokens (case, accents, look-alikes, titles, word order, commas and underscores aside). Complete
spellings are joined through a symmetric-delete neighbourhood of any one of their tokens beside the first letters of the others; the
tokens of the two, assigned to one another at the least cost, may differ by a slip or two in all, and an abbreviation may stand
for what it begins. What is linked in this way is one name. Shorter spellings (initials, a single name, a pet name, an acronym)
are aligned with the complete ones by keys that permit initials, abbreviations and slips, and join a name only if it is the only one
that fits.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talesieve.llm.arrowrun import map_columns
from talesieve.llm.canonical import deletions, edit_distance
from talesieve.llm.lookalike import INTO, LATIN, compose, script_counts
from talesieve.sources.tables import materialise

#: Letters from which on the tokens of two spellings, assigned to one another, may have two slips in all instead of one.
LONG = 12
#: Words for no one in particular.
NO_NAME = """narrator narration system unknown unnamed anonymous none null nobody somebody someone anyone everyone everybody all both
he she it they we you i me him her them us his hers their who voice voices crowd people others other another stranger man woman
boy girl child guard guards soldier soldiers villager villagers announcer speaker author text title heading
он она оно они мы вы ты я рассказчик система неизвестный голос толпа кто
er sie wir erzähler unbekannt él ella ellos ellas narrador narradora desconocido il elle ils elles narrateur inconnu
旁白 他 她 它 我 系统 未知 ナレーター 語り手 彼 彼女 不明 시스템 나레이터 그 그녀 ผู้บรรยาย เขา वह कथावाचक""".split()
#: Titles.
TITLES = """mr mrs ms miss mister master mistress sir madam madame lady lord dame dr doctor prof professor capt captain sgt sergeant lt
lieutenant col colonel cpl corporal maj major gen general adm admiral cmdr commander elder eldest saint st rev reverend father mother
brother sister king queen prince princess duke duchess count countess baron baroness judge hon uncle aunt old young
г-н г-жа господин госпожа д-р доктор проф профессор капитан сержант кап серж ген генерал мастер леди
herr frau fräulein señor señora señorita don doña sr sra srta monsieur mademoiselle mme mlle""".split()
#: Nouns of organisations, each with its short forms.
ORGANISATIONS = {"council": "cncl cncil coun", "guild": "gld gd", "order": "ord or", "house": "hse hs", "brotherhood": "bhd brhd bro", "company": "co cmp comp", "sisterhood": "shd", "society": "soc", "association": "assn assoc", "academy": "acad", "army": "", "clan": "cl", "sect": "", "league": "lg", "court": "ct", "circle": "cir", "union": "un", "church": "ch", "temple": "tpl", "school": "sch", "tribe": "", "alliance": "all", "fellowship": "flw", "legion": "leg", "band": ""}
#: Pet names of given names.
PET_NAMES = {
    "abigail": "abby abbie gail", "alexander": "alex al sandy xander", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony", "arthur": "art artie", "benjamin": "ben benny benji", "catherine": "cathy cate kate kitty", "charles": "charlie chuck",
    "charlotte": "lottie charlie", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "dorothy": "dot dolly dottie", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora", "elizabeth": "liz lizzie beth betty bess eliza libby betsy", "emily": "em emmy", "frances": "fran fanny",
    "francis": "frank", "frederick": "fred freddy freddie fritz", "gabriel": "gabe", "george": "georgie", "gregory": "greg", "harold": "harry hal", "henry": "harry hank", "isabella": "bella izzy isa ella", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "jonathan": "jon johnny jonny nathan", "john": "johnny jack", "joseph": "joe joey", "josephine": "josie jo fina", "joshua": "josh", "katherine": "kate kathy katie kitty kat", "kenneth": "ken", "lawrence": "larry", "leonard": "len leo", "margaret": "maggie meg peg peggy marge greta", "matthew": "matt", "michael": "mike mick", "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "samantha": "sam", "sarah": "sally", "stephen": "steve", "susan": "sue susie",
    "theodore": "theo ted teddy", "theodora": "theo dora", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vicki tori vic", "virginia": "ginny", "walter": "walt wally", "william": "will bill billy willie liam",
}
_FORMAL: dict[str, list[str]] = {}
for _formal, _pets in PET_NAMES.items():
    for _pet in _pets.split():
        _FORMAL.setdefault(_pet, []).append(_formal)
_SHORT_ORG = {s: n for n, shorts in ORGANISATIONS.items() for s in shorts.split()}
_NEAR_ORGANISATIONS = {d for o in ORGANISATIONS if len(o) > 3 for d in deletions(o, 1)}
_SMALL = {"of", "the", "and"}
_pet_ending = re.compile("^(.{3,5}?)(?:y|ie|i|ey)$")
_word = re.compile(r"([^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_])|[̀-ͯ])*)(\.?)")
_acronym = re.compile(r"^(?:[^\W\d_]\.?\s?){2,6}$")


def _bare(text: str) -> str:
    """Lower case without accents, look-alikes in the name's main script."""
    s = unicodedata.normalize("NFD", compose(text))
    counts = script_counts(s)
    main = counts.most_common(1)[0][0] if counts else LATIN
    s = "".join(INTO[main].get(c, c) for c in s).casefold()
    return "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")


def _without_small(words: list[str]) -> list[str]:
    """Words of an organisation without 'of' and 'the', also where these are mistyped in their usual places."""
    slip = lambda w, small: len(w) <= len(small) + 1 and edit_distance(w, small) <= 1
    out, article, before = [], "the" in words, ""
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if w in _SMALL:
            before = w
        elif "of" not in words and i and after and slip(w, "of") and (after == "the" or slip(after, "the")):
            before = "of"
        elif not article and after and slip(w, "the") and (i == 0 or before == "of"):
            before = "the"
        else:
            out.append(w)
            before = ""
    return out


def parse(name: str) -> tuple[str, list[str], list[str]] | None:
    """Kind ('full', 'short' or 'acronym'), complete tokens and initials, both in order of the alphabet; None: no name."""
    text = compose(name)
    if not text or any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return None
    bare = _bare(text).replace("_", " ")
    if " ".join(bare.split()) in NO_NAME or bare.strip(" .?!") in NO_NAME:
        return None
    found = [(m[1].replace("’", "'"), bool(m[2])) for m in _word.finditer(bare)]
    if not found:
        return None
    if len(found) > 1 and all(len(w) == 1 for w, _ in found) or len(found) == 1 and text.isupper() and 2 <= len(text) <= 4:
        return "acronym", [], [c for w, _ in found for c in w]
    is_org = any(w in _SMALL or w in ORGANISATIONS for w, _ in found) or found[0][1] and found[0][0] in _SHORT_ORG and len(found) > 2
    if is_org:
        words = [_SHORT_ORG.get(w, w) if dot else w for w, dot in found]
        words = _without_small(words)
        return ("full" if len(words) > 1 else "short", sorted(words), []) if words else None
    while len(found) > 1 and found[0][0] in TITLES and (len(found[0][0]) > 1):
        found = found[1:]
    # a full stop behind several letters tells an abbreviation
    whole = sorted(w + "." * (dot and len(w) > 2 and len(found) > 1) for w, dot in found if len(w) > 1)
    initials = sorted(w for w, _ in found if len(w) == 1)
    if not whole:
        return "acronym", [], initials
    return ("full" if len(whole) > 1 and not initials else "short"), whole, initials


def spelled(kind: str, whole: list[str], initials: list[str]) -> str:
    return f"{kind}:{' '.join(whole)}|{''.join(initials)}"


def slips_allowed(token: str) -> int:
    """Edits of one token: none of short ones, two of long ones."""
    return 0 if len(token) < 3 else 1 if len(token) < 10 else 2


def most_slips(a: list[str], b: list[str]) -> int:
    return 1 + (min(sum(map(len, a)), sum(map(len, b))) >= LONG or len(a) == len(b) == 1)


def slip_keys(whole: list[str]) -> set[str]:
    """Of each token its neighbourhood by deletion (of an abbreviation its beginning), with the first letters of the others."""
    keys = set()
    for i, t in enumerate(whole):
        others = "".join(sorted(o[0] for o in whole[:i] + whole[i + 1 :]))
        keys |= {f"{others}|{d}" for d in deletions(t.rstrip("."), slips_allowed(t))}
    return keys


def token_cost(a: str, b: str) -> float:
    """What it costs that one token stands for the other: nothing if equal, half a slip to spell out an abbreviation, else its slips."""
    if a == b:
        return 0.0
    for x, y in ((a, b), (b, a)):
        if x.endswith(".") and y.startswith(x[:-1]):
            return 0.5
    a, b = a.rstrip("."), b.rstrip(".")
    allowed = min(slips_allowed(a), slips_allowed(b))
    if abs(len(a) - len(b)) > allowed:
        return 99.0
    d = edit_distance(a, b)
    return float(d) if d <= allowed and (d < 2 or a[0] == b[0]) else 99.0


def assigned_cost(a: list[str], b: list[str]) -> float:
    """Cost of the best assignment of the tokens of ``a`` to those of ``b``, one to one, by shortest augmenting paths."""
    if len(a) != len(b):
        return 99.0
    n = len(a)
    costs = [[token_cost(x, y) for y in b] for x in a]
    # potentials of rows and columns; of each column the row assigned to it
    row_of, of_row, of_column = [0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[at]:
            done[at] = True
            row, step, following = row_of[at], float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    reduced = costs[row - 1][j - 1] - of_row[row] - of_column[j]
                    if reduced < least[j]:
                        least[j], came[j] = reduced, at
                    if least[j] < step:
                        step, following = least[j], j
            for j in range(n + 1):
                if done[j]:
                    of_row[row_of[j]] += step
                    of_column[j] -= step
                else:
                    least[j] -= step
            at = following
        while at:
            row_of[at] = row_of[came[at]]
            at = came[at]
    return sum(costs[row_of[j] - 1][j - 1] for j in range(1, n + 1))


@lru_cache(100_000)
def _names_organisation(token: str) -> bool:
    """Whether a token is an organisation's noun, or one but for a slip."""
    return token in ORGANISATIONS or len(token) > 3 and not _NEAR_ORGANISATIONS.isdisjoint(deletions(token, 1)) and min(edit_distance(token, o) for o in ORGANISATIONS) <= 1


def offered_keys(whole: list[str], initials: list[str]) -> list[tuple[str, str]]:
    """Keys under which a name can be found by shorter spellings; with a key for pet names, the token that it stands for."""
    keys = {(f"s:{t}", "") for t in whole} | {(f"x:{' '.join(whole)}", "")}
    for i, t in enumerate(whole):
        others = whole[:i] + whole[i + 1 :]
        rest = " ".join(others)
        keys.add((f"i:{t[0]}|{rest}", ""))
        if len(t) > 3:
            keys |= {(f"n:{t[:3]}|{tail}", t) for tail in (rest, "", *(f"{o[0]}." for o in others))}
        if t in ORGANISATIONS:
            keys.add((f"o:{rest}", ""))
    if any(map(_names_organisation, whole)):
        keys.add(("a:" + "".join(sorted(t[0] for t in whole)), ""))
    if initials:
        keys.add((f"i:{''.join(initials)}|{' '.join(whole)}", ""))
    return sorted(keys)


def slipped_keys(token: str, initial: str | None) -> list[str]:
    """Keys under which a token of a name is found with slips in it: alone, or beside the first letter of the only other one."""
    if len(token) < 5:
        return []
    near = deletions(token, slips_allowed(token))
    return [f"S:{d}" for d in near] + ([f"I:{initial}|{d}" for d in near] if initial else [])


def asked_keys(kind: str, whole: list[str], initials: list[str]) -> list[tuple[int, str, str]]:
    """Rank, key and stem of what a spelling looks for: those of the least rank first. The stem must begin the token found; one behind a
    tilde must be it but for slips."""
    if kind == "acronym":
        return [(0, "a:" + "".join(sorted(initials)), "")]
    asked = []
    for i, t in enumerate(whole):
        rest = whole[:i] + whole[i + 1 :]
        for formal in _FORMAL.get(t, []):
            if rest and not initials:
                asked.append((1, "x:" + " ".join(sorted([*rest, formal])), ""))
            elif initials and not rest:
                asked.append((1, f"i:{''.join(initials)}|{formal}", ""))
            elif not rest:
                asked.append((1, f"s:{formal}", ""))
        if m := _pet_ending.match(t):
            asked.append((2, f"n:{m[1][:3]}|" + (f"{initials[0]}." if initials else " ".join(rest)), m[1]))
    if kind == "short":
        if initials:
            asked.append((0, f"i:{''.join(initials)}|{' '.join(whole)}", ""))
        elif len(whole) == 1:
            asked.append((0, f"s:{whole[0]}", ""))
        if len(whole) == 1 and len(whole[0]) > 4 and len(initials) < 2:
            asked += [(4, f"I:{initials[0]}|{d}" if initials else f"S:{d}", f"~{whole[0]}") for d in deletions(whole[0], slips_allowed(whole[0]))]
        asked.append((3, f"o:{' '.join(whole)}", ""))
    return asked


def _tokens_of(form: str) -> list[str]:
    return form.partition(":")[2].partition("|")[0].split(" ")


def linked_pairs(names: DataFrame, scope: str, name: str) -> DataFrame:
    """Pairs ``name_a < name_b`` of different spellings of one name within a scope.

    ``names`` may repeat rows and have other columns. Null or blank names, and words for no one in particular, are linked
    to nothing; a null scope is a scope of its own. A spelling that fits several names is linked to none of them.
    """
    parsed_schema = T.StructType([T.StructField(scope, names.schema[scope].dataType), T.StructField("spelling", T.StringType()), T.StructField("form", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("whole", T.ArrayType(T.StringType())), T.StructField("initials", T.ArrayType(T.StringType()))])

    def read(cols: dict[str, list]) -> dict[str, list]:
        rows = [(s, n, spelled(*p), *p) for s, n in zip(cols[scope], cols[name]) if n and (p := parse(n))]
        return {c: [r[i] for r in rows] for i, c in enumerate(parsed_schema.names)}

    distinct = names.select(scope, name).distinct()
    parsed = materialise(map_columns(distinct, parsed_schema, read).withColumn("at", F.coalesce(F.col(scope).cast("string"), F.lit("\x00"))))
    forms = parsed.groupBy("at", "form").agg(F.first("kind").alias("kind"), F.first("whole").alias("whole"), F.first("initials").alias("initials"))
    full = forms.where("kind = 'full'").select("at", "form", "whole")
    alone = forms.where("kind = 'short' and size(whole) = 1 and size(initials) = 0 and length(whole[0]) > 4").select("at", "form", "whole")
    linkable = full.unionByName(alone).select("at", "form")

    # keys and forms travel as hashes; what meets is looked at in full
    scoped = F.xxhash64("at", "key").alias("h")
    key_schema = T._parse_datatype_string("at string, f long, key string")

    def slips(cols: dict[str, list]) -> dict[str, list]:
        rows = [(a, n, k) for a, n, f in zip(cols["at"], cols["f"], cols["form"]) for k in slip_keys(_tokens_of(f))]
        return {c: [r[i] for r in rows] for i, c in enumerate(key_schema.names)}

    numbered = linkable.select("at", "form", F.xxhash64("at", "form").alias("f"))
    keyed = map_columns(numbered, key_schema, slips).select(scoped, "f")
    near_schema = T._parse_datatype_string("at string, a string, b string")

    def judge(cols: dict[str, list]) -> dict[str, list]:
        rows = [(t, x, y) for t, x, y in zip(cols["at"], cols["a"], cols["b"]) if assigned_cost(_tokens_of(x), _tokens_of(y)) <= most_slips(_tokens_of(x), _tokens_of(y))]
        return {c: [r[i] for r in rows] for i, c in enumerate(near_schema.names)}

    met = keyed.alias("p").join(keyed.alias("q"), (F.col("p.h") == F.col("q.h")) & (F.col("p.f") < F.col("q.f"))).select(F.col("p.f").alias("f"), F.col("q.f").alias("g")).distinct()
    left, right = numbered.select("f", F.col("at").alias("at"), F.col("form").alias("a")), numbered.select(F.col("f").alias("g"), F.col("at").alias("at_b"), F.col("form").alias("b"))
    near = map_columns(met.join(left, "f").join(right, "g").where("at = at_b").select("at", "a", "b"), near_schema, judge)
    linked = components(linkable, near)
    names_of = linked.join(full.select("at", "form"), ["at", "form"], "left_semi")

    offer_schema = T._parse_datatype_string("at string, label string, key string, token string")

    def offers(cols: dict[str, list]) -> dict[str, list]:
        rows = [(a, c, k, t) for a, c, w, i in zip(cols["at"], cols["label"], cols["whole"], cols["initials"]) for k, t in offered_keys(w, i)]
        return {c: [r[i] for r in rows] for i, c in enumerate(offer_schema.names)}

    ask_schema = T._parse_datatype_string("at string, form string, rank int, key string, stem string")

    def asks(cols: dict[str, list]) -> dict[str, list]:
        rows = [(a, f, *k) for a, f, t, w, i in zip(cols["at"], cols["form"], cols["kind"], cols["whole"], cols["initials"]) for k in asked_keys(t, w, i)]
        return {c: [r[i] for r in rows] for i, c in enumerate(ask_schema.names)}

    def slipped(cols: dict[str, list]) -> dict[str, list]:
        rows = [(a, c, k, t) for a, c, t, i in zip(cols["at"], cols["label"], cols["token"], cols["initial"]) for k in slipped_keys(t, i)]
        return {c: [r[i] for r in rows] for i, c in enumerate(offer_schema.names)}

    def fit(asking: DataFrame, offering: DataFrame, with_slips: bool = False) -> DataFrame:
        """Of each asking form, the only name that fits at the least rank at which any fits."""
        offered = map_columns(offering.select("at", "label", "whole", "initials"), offer_schema, offers)
        if with_slips:  # once a name and token, however often the name is spelled with it
            other = F.when(F.size("whole") == 2, F.substring(F.get("whole", 1 - F.col("i")), 1, 1))
            tokens = offering.select("at", "label", "whole", F.posexplode("whole").alias("i", "token")).select("at", "label", "token", other.alias("initial")).distinct()
            offered = offered.unionByName(map_columns(tokens, offer_schema, slipped))
        check = F.hash("at", "key").alias("h2")
        sought = map_columns(asking.select("at", "form", "kind", "whole", "initials"), ask_schema, asks).select(scoped, check, "at", "form", "rank", "stem")
        got = sought.join(offered.select(scoped, check, "label", "token"), ["h", "h2"])
        meant, letters = F.regexp_replace("stem", "^~", ""), lambda c: F.array_sort(F.split(c, ""))
        slips = F.levenshtein("token", meant)
        least = F.least(F.length("token"), F.length(meant))
        near = (slips <= 1) | ((slips == 2) & (F.substring("token", 1, 1) == F.substring(meant, 1, 1)) & ((least >= 10) | (letters(F.col("token")) == letters(meant))))
        got = got.where((F.col("form") != F.col("label")) & F.when(F.startswith("stem", F.lit("~")), near).otherwise(F.startswith("token", F.col("stem"))))
        ranked = got.groupBy("at", "form", "rank").agg(F.min("label").alias("label"), F.max("label").alias("last"))
        best = ranked.groupBy("at", "form").agg(F.min_by(F.struct("label", "last"), "rank").alias("x"))
        return best.where("x.label = x.last").select("at", "form", "x.label")

    whole = forms.where("kind = 'full'")
    pets = fit(whole, whole.join(names_of, ["at", "form"]))  # a pet name beside a complete one
    named = materialise(names_of.join(pets.withColumnRenamed("label", "to"), ["at", "form"], "left").select("at", "form", F.coalesce("to", "label").alias("label")))
    short = forms.where("kind != 'full'")
    first = fit(short, whole.join(named, ["at", "form"]), with_slips=True)
    among = linked.join(alone.select("at", "form"), ["at", "form"], "left_semi").withColumnRenamed("label", "own")
    labels = materialise(short.select("at", "form").join(first, ["at", "form"], "left").join(among, ["at", "form"], "left").select("at", "form", F.coalesce("label", "own", "form").alias("label")).unionByName(named))
    # what is short and stands for itself may still be sought by what is shorter
    left = short.where(F.size("whole") > 0).join(labels.where("form = label"), ["at", "form"])
    second = fit(left.where("size(initials) = 0"), left.where("size(initials) > 0"))
    final = labels.join(second.withColumnRenamed("label", "to"), ["at", "form"], "left").select("at", "form", F.coalesce("to", "label").alias("label"))
    placed = materialise(parsed.join(final, ["at", "form"]).select(scope, "at", "label", "spelling"))
    a, b = placed.alias("a"), placed.alias("b")
    return a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.spelling") < F.col("b.spelling"))).select(F.col(f"a.{scope}").alias(scope), F.col("a.spelling").alias("name_a"), F.col("b.spelling").alias("name_b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``at, form, label``: the least form that each one is connected with, by propagation of least labels."""
    both = materialise(edges.select("at", F.col("a").alias("form"), F.col("b").alias("other")).unionByName(edges.select("at", F.col("b").alias("form"), F.col("a").alias("other"))))
    labels = materialise(nodes.withColumn("label", F.col("form")))
    while True:
        heard = both.join(labels.select("at", F.col("form").alias("other"), "label"), ["at", "other"]).groupBy("at", "form").agg(F.min("label").alias("heard"))
        nxt = materialise(labels.join(heard, ["at", "form"], "left").select("at", "form", F.least("label", "heard").alias("label"), F.coalesce(F.col("heard") < F.col("label"), F.lit(False)).alias("changed")))
        labels = nxt.drop("changed")
        if nxt.where("changed").isEmpty():
            return labels
