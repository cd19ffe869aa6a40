"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates their reliabilities and trains a span classifier.

Candidates are the base spans (strict pattern and check; these always stay) and looser forms of each kind: e-mail addresses with
bracketed or spelt-out signs, defanged addresses, card numbers with other separators or inside a longer run of digits whose match failed the check (a number
or an address stands next to it), telephone numbers without a country code or inside such a run. Four labelers vote yes, no or abstain: pattern (check digit,
ranges), gazetteer (known endings, issuers' prefixes, reserved networks, calling codes), context (cue and counter-cue words before the span) and borders
(glued to letters or digits). Votes and features are counted over all candidates of the corpus. A vote pattern is one of 3**4, so EM runs on a table
of at most 324 rows, as one SQL expression. The posteriors are soft labels that train a naive Bayes classifier over span features (form, borders,
length, hashed word before), whose tables are bounded as well. Looser spans that the classifier accepts are added.

Everything is DataFrame expressions. Texts are scanned twice, once for the counts and once for the result, and never written or shuffled: finding and
redacting are projections, with the model as one broadcast row.

Defined cases: a null or empty text has no spans (its digest is that of the empty string). Offsets count code points, end exclusive. Repeated rows get
equal spans; ids take no part, so rows with a null id or with the id of another row have the spans of their own text. Added spans do not overlap base spans. Without candidates nothing is added. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornloom.llm._shared import Scratch

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive where nothing needs to be given back, so that long runs cost no stack; a match starts at the
#: start of a run of its characters or where the last match ended, which changes no match and keeps the search linear. A card's run of digits is only taken from 16 on, as shorter ones fail the check.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The looser forms.
_AT, _DOT = r"\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?", r"\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_AT}[A-Za-z0-9-]{{1,63}}+(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}+){{1,8}}+|\x20at\x20[A-Za-z0-9-]{{1,63}}+(?:\x20dot\x20[A-Za-z0-9-]{{1,63}}+){{1,8}}+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}([\x20./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: Gazetteers (endings of domains, issuers' prefixes of card numbers, calling codes, first parts of addresses that name no host) and context words.
ENDINGS = ["com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl", "example", "test"]
ISSUERS = ["4", "51", "52", "53", "54", "55", *map(str, range(2221, 2721)), "34", "37", "6011", "644", "645", "646", "647", "648", "649", "65", *map(str, range(3528, 3590)), "62"]
CALLING = [
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "385", "386", "420", "421", "852", "886", "971", "972",
]
NO_HOST = ["0", "10", "127", *map(str, range(224, 256))]
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|courriel|correo|schreib)",
    "ip": r"(?i)(\bip\b|address|server|host|ping|login|adresse)",
    "card": r"(?i)(card|visa|amex|master|credit|pay|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|sms|whatsapp|anruf|appel|llama)",
}
COUNTER_CUES = r"(?i)(version|release|isbn|issn|order|invoice|serial|section|build|part no|item|figure|page|doi)\W*$"
LABELERS = 4
#: Production parameters: EM rounds, acceptance of an added span, buckets of the hashed word, characters of context.
ROUNDS, ACCEPT, HASHED, NEAR = 25, 0.9, 64, 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        c = F.substring(back, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * c - F.when(c > 4, 9).otherwise(0)).otherwise(c)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _small_parts(parts: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(parts, lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))


def strict(kind: str, x: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return _small_parts(F.split(x, r"\."))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(16, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: strict(kind, s.x)


def _numbered(i: int):
    return lambda s: F.struct(F.lit(i).alias("kind"), s.start.alias("start"), s.end.alias("end"))


def _listed(x: Column, names: list[str]) -> Column:
    """Whether a gazetteer has x; one literal, however long."""
    return F.contains(F.lit(f" {' '.join(names)} "), F.concat(F.lit(" "), x, F.lit(" ")))


def votes(kind: str, x: Column, before: Column, after: Column) -> list[Column]:
    """1, 0 or -1 (abstains) of each labeler."""
    d = _digits(x)
    begin = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.left(d, i))
    if kind == "email":
        last = F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1))
        pattern, gazetteer = F.when(last.rlike(r"^[a-z]{2,}$"), 1).otherwise(0), F.when(_listed(last, ENDINGS), 1).when(F.length(last) < 2, 0).otherwise(-1)
    elif kind == "ip":
        first = F.regexp_extract(x, "^[0-9]+", 0)
        pattern = F.when(_small_parts(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))), 1).otherwise(0)
        gazetteer = F.when(_listed(first, NO_HOST), -1).otherwise(1)
    elif kind == "card":
        pattern, gazetteer = F.when(luhn(d), 1).otherwise(0), F.when(F.exists(begin(4), lambda b: _listed(b, ISSUERS)), 1).otherwise(0)
    else:
        pattern = F.when(F.length(d).between(8, 15), 1).otherwise(0)
        gazetteer = F.when(x.startswith("+"), F.when(F.exists(begin(3), lambda b: _listed(b, CALLING)), 1).otherwise(0)).when(d.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1)
    context = F.when(before.rlike(COUNTER_CUES), 0).when(before.rlike(CUES[kind]), 1).otherwise(-1)
    glued = before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")
    return [pattern, gazetteer, context, F.when(glued, 0).otherwise(1)]


def _found(d: DataFrame, keep: list[str], column: str, pattern: str, when: Column) -> DataFrame:
    """Adds `column`: the matches of the pattern as array<struct<start, end, x, before, after>>."""
    m = F.when(when, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    d = d.withColumn("_m", m)
    gaps = F.transform(F.split("_t", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("before"), F.left(g, F.lit(NEAR)).alias("after")))
    d = d.withColumn("_g", F.when(F.size("_m") > 0, gaps))

    def step(a: Column, i: Column) -> Column:
        start = a.at + F.get("_g", i).n
        return F.struct((start + F.length(F.get("_m", i))).alias("at"), F.array_append(a.starts, start).alias("starts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    d = d.withColumn("_s", F.when(F.size("_m") > 0, F.aggregate(F.sequence(F.lit(0), F.size("_m") - 1), none, step, lambda a: a.starts)))
    span = lambda x, i: F.struct(F.get("_s", i).alias("start"), (F.get("_s", i) + F.length(x)).alias("end"), x.alias("x"), F.get("_g", i).before.alias("before"), F.get("_g", i + 1).after.alias("after"))
    return d.withColumn(column, F.when(F.size("_m") > 0, F.transform("_m", span)).otherwise(F.array().cast("array<struct<start:int,end:int,x:string,before:string,after:string>>"))).drop("_m", "_g", "_s")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base (array of kind number, start, end) and candidates with votes and features, for each row."""
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_has", F.col("_t").rlike("[0-9]"))
    names = []
    for kind in KINDS:
        when = {"email": F.contains(F.col("_t"), F.lit("@")), "phone": F.col("_has") & F.contains(F.col("_t"), F.lit("+"))}.get(kind, F.col("_has"))
        d = _found(d, [key], f"_b_{kind}", BASE[kind], when)
        d = d.withColumn(f"_b_{kind}", F.filter(f"_b_{kind}", _checked(kind)))
        # The looser e-mail forms need one of their signs; a plain test spares the pattern on most texts.
        loose_when = F.col("_t").rlike(r"(?i)[\[({<]\x20?(?:at|@)\x20?[\])}>]|\x20dot\x20") if kind == "email" else F.col("_has")
        d = _found(d, [key], f"_l_{kind}", LOOSE[kind], loose_when)
        names += [f"_b_{kind}", f"_l_{kind}"]
    base = F.concat(*(F.transform(f"_b_{kind}", _numbered(i)) for i, kind in enumerate(KINDS)))
    d = d.select(key, *names, base.alias("base"))

    def candidate(i: int, kind: str, loose: int):
        def make(s: Column) -> Column:
            v = votes(kind, s.x, s.before, s.after)
            word = F.lower(F.regexp_extract(s.before, r"(\p{L}+)\P{L}*$", 1))
            features = F.array(
                F.concat(F.lit("form"), F.lit(loose)),
                F.concat(F.lit("word"), F.pmod(F.xxhash64(word), F.lit(HASHED))),
                F.concat(F.lit("length"), F.least(F.length(s.x), F.lit(40))),
                F.concat(F.lit("edge"), v[3].cast("string"), F.when(s.after.rlike(r"^(\s|[.,;:)]?(\s|$))|^$"), "e").otherwise("x")),
            )
            return F.struct(F.lit(i).alias("kind"), s.start.alias("start"), s.end.alias("end"), F.lit(loose).alias("loose"), F.array(*v).alias("votes"), features.alias("features"))

        return make

    apart = lambda s: ~F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end))
    parts = [F.transform(f"_b_{kind}", candidate(i, kind, 0)) for i, kind in enumerate(KINDS)]
    parts += [F.transform(F.filter(f"_l_{kind}", apart), candidate(i, kind, 1)) for i, kind in enumerate(KINDS)]
    return d.select(key, "base", F.concat(*parts).alias("candidates"))


def reliabilities(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, p (share of true spans) and for each labeler l: yes_l and no_l, its chance of a yes on true and on false spans.

    Dawid-Skene EM with abstentions on the counts of vote patterns, as one expression per kind.
    """
    counts = candidates.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("kind").agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("rows"))  # at most 3**LABELERS entries
    fields = ["p"] + [f"{c}_{i}" for i in range(LABELERS) for c in ("yes", "no")]
    start = F.struct(F.lit(0.7).alias("p"), *(F.lit(0.8 if c == "yes" else 0.3).alias(f"{c}_{i}") for i in range(LABELERS) for c in ("yes", "no")))
    sums = ["n", "g"] + [f"{c}_{i}" for i in range(LABELERS) for c in ("t1", "t", "f1", "f")]

    def round_(a: Column, _: Column) -> Column:
        soft = F.transform("rows", lambda r: F.struct(r.votes.alias("votes"), r.n.alias("n"), posterior(r.votes, a).alias("g")))

        def add(s: Column, r: Column) -> Column:
            new = {"n": s.n + r.n, "g": s.g + r.n * r.g}
            for i in range(LABELERS):
                v = F.get(r.votes, F.lit(i))
                new[f"t1_{i}"] = s[f"t1_{i}"] + F.when(v == 1, r.n * r.g).otherwise(0.0)
                new[f"t_{i}"] = s[f"t_{i}"] + F.when(v >= 0, r.n * r.g).otherwise(0.0)
                new[f"f1_{i}"] = s[f"f1_{i}"] + F.when(v == 1, r.n * (1 - r.g)).otherwise(0.0)
                new[f"f_{i}"] = s[f"f_{i}"] + F.when(v >= 0, r.n * (1 - r.g)).otherwise(0.0)
            return F.struct(*(new[k].alias(k) for k in sums))

        def finish(s: Column) -> Column:
            # Smoothed towards a labeler that is right more often than not, so the two classes cannot swap.
            out = {"p": (s.g + 1) / (s.n + 2)}
            for i in range(LABELERS):
                out[f"yes_{i}"] = (s[f"t1_{i}"] + 4.0) / (s[f"t_{i}"] + 5.0)
                out[f"no_{i}"] = (s[f"f1_{i}"] + 1.0) / (s[f"f_{i}"] + 5.0)
            return F.struct(*(out[k].alias(k) for k in fields))

        return F.aggregate(soft, F.struct(*(F.lit(0.0).alias(k) for k in sums)), add, finish)

    fitted = packed.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("r"))
    return fitted.select("kind", "r.*")


def posterior(v: Column, a: Column) -> Column:
    """The chance that a span with these votes is true; a: struct or row with the reliabilities."""
    true, false = a["p"], 1 - a["p"]
    for i in range(LABELERS):
        x = F.get(v, F.lit(i))
        true = true * F.when(x == 1, a[f"yes_{i}"]).when(x == 0, 1 - a[f"yes_{i}"]).otherwise(1.0)
        false = false * F.when(x == 1, a[f"no_{i}"]).when(x == 0, 1 - a[f"no_{i}"]).otherwise(1.0)
    return true / (true + false)


def counted(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """kind, votes, features, n: the candidates of all texts, counted."""
    # Written first: a reader of single fields would make Spark compute the whole scan once for each field.
    found = scratch.settle(scan(docs.select(F.lit(0).alias("_pii_key"), F.col(text)), "_pii_key", text).select("candidates"), "pii-candidates")
    counts = found.where(F.size("candidates") > 0).select(F.inline("candidates")).groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    counts = scratch.settle(counts, "pii-counts")
    scratch.drop("pii-candidates")
    return counts


def learned(candidates: DataFrame) -> DataFrame:
    """From the counted candidates one row with `_model`: for each kind, the labelers' reliabilities r and the naive Bayes weights of the span features."""
    # All tables that are broadcast here have one row per kind, or per kind and feature value (at most KINDS x (HASHED + 60)).
    rates = reliabilities(candidates)
    rates = rates.select("kind", F.struct(*(c for c in rates.columns if c != "kind")).alias("r"))
    soft = candidates.join(F.broadcast(rates), "kind").withColumn("g", posterior(F.col("votes"), F.col("r"))).drop("r")
    soft = soft.select("kind", "features", (F.col("g") * F.col("n")).alias("g"), ((1 - F.col("g")) * F.col("n")).alias("h"))
    each = soft.select("kind", "g", "h", F.explode("features").alias("feature"))
    table = each.groupBy("kind", "feature").agg((F.sum("g") + 1.0).alias("t"), (F.sum("h") + 1.0).alias("f"))
    total = soft.groupBy("kind").agg((F.sum("g") + 1.0).alias("kt"), (F.sum("h") + 1.0).alias("kf"))
    evidence = table.join(F.broadcast(total), "kind").groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.log((F.col("t") / F.col("kt")) / (F.col("f") / F.col("kf"))).alias("w")))).alias("weights"))
    model = evidence.join(F.broadcast(rates), "kind").select("kind", F.struct("r", "weights").alias("m"))
    return model.agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("_model"))


def chance(s: Column, model: Column) -> Column:
    """The chance that a candidate is true: the votes' posterior combined with the naive Bayes evidence of the span's features."""
    m = F.element_at(model, s.kind)
    g = posterior(s.votes, m.r)
    # Features repeat what the form says; at half weight they break ties of the votes and do not drown them.
    weight = F.aggregate(s.features, F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(m.weights, f), F.lit(0.0)) * 0.5)
    odds = F.log(F.greatest(g, F.lit(1e-9)) / F.greatest(1 - g, F.lit(1e-9))) + weight
    return 1 / (1 + F.exp(-odds))


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and span_list for each row."""
    scratch = Scratch(docs.sparkSession)
    model = scratch.settle(learned(counted(docs, scratch, text)), "pii-model")
    scratch.drop("pii-counts")
    # One row with a few hundred numbers.
    # Each row is judged from its own candidates: no join on the key, which may be null or repeated.
    d = scan(docs, key, text).crossJoin(F.broadcast(model))
    taken = F.filter("candidates", lambda s: (s.loose == 1) & (chance(s, F.col("_model")) >= accept))
    d = d.withColumn("_added", F.transform(taken, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))).drop("candidates", "_model")
    count = lambda i: F.size(F.filter("base", lambda s: s.kind == i)).cast("long")
    every = F.array_sort(F.concat("base", "_added"))
    return d.select(key, *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("_added").cast("long").alias("n_added"), every.alias("span_list"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by <KIND>; all other columns stay. A null text stays null.

    The whole row travels with its own spans, so null or repeated ids make no difference.
    """
    d = find(docs.select(F.struct(*docs.columns).alias("_pii_row"), F.col(text)), "_pii_row", text)
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    order = F.array_sort(F.transform("span_list", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col("_pii_row")[text]

    def step(a: Column, s: Column) -> Column:
        # Spans of two kinds may overlap: the later one only extends what is hidden.
        gap = F.when(s.start >= a.at, F.concat(F.substring(t, a.at + 1, s.start - a.at), F.get(name, s.kind))).otherwise(F.lit(""))
        return F.struct(F.concat(a.out, gap).alias("out"), F.greatest(a.at, s.end).alias("at"))

    hidden = F.aggregate(order, first, step, lambda a: F.concat(a.out, F.substring(t, a.at + 1, F.length(t))))
    return d.select(*(F.when(F.size("span_list") == 0, t).otherwise(hidden).alias(c) if c == text else F.col("_pii_row")[c].alias(c) for c in docs.columns))
