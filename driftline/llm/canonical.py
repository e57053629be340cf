"""Free-entered names mapped to the entries of a catalogue, by repaired tokens ranked with soft TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.runtime import written

UNMATCHED = "UNMATCHED"
#: Letters with marks, and the plain letters they are read as.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: Signs that are read as spaces.
SPACES = "   \t\r\n"
#: Digits of the cycles of packed designations.
CYCLES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

NUMBER = r"[\dO]+(?:,[\dO]{3})*"
#: Longer words may hold two slips, shorter ones one, very short ones none.
TWO_SLIPS, ONE_SLIP = 8, 4
#: Terms of more letters are met through their thirds instead of their deletion variants.
LONG = 24


def _clean(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(value, SPACES, " " * len(SPACES)), " +", " "))


def _number(text: Column) -> Column:
    digits = F.regexp_replace(F.translate(text, "O", "0"), "[^0-9]", "")
    return F.concat(F.lit("n:"), F.regexp_replace(digits, "^0+", ""))


def _designation(text: Column) -> Column:
    """``1993-nb014``, ``1993_NB_14``, ``1993 NB14`` as ``d:1993NB14``; the letter O among digits is a zero."""
    t = F.upper(F.regexp_replace(text, r"[\s_\-]", ""))
    order = F.regexp_replace(F.translate(F.substr(t, F.lit(7)), "O", "0"), "^0+", "")
    return F.concat(F.lit("d:"), F.translate(F.substring(t, 1, 4), "O", "0"), F.substring(t, 5, 2), order)


def _packed(text: Column) -> Column:
    """``K01Wa8U`` as ``d:2001WU368``: century letter, year, half-month, cycle in base 62 and 10, second letter."""
    century = F.lit(18) + F.instr(F.lit("IJK"), F.substring(text, 1, 1)) - 1
    cycle = (F.instr(F.lit(CYCLES), F.substring(text, 5, 1)) - 1) * 10 + F.substring(text, 6, 1).cast("int")
    count = F.when(cycle > 0, cycle.cast("string")).otherwise(F.lit(""))
    return F.concat(F.lit("d:"), century.cast("string"), F.substring(text, 2, 2), F.substring(text, 4, 1), F.substring(text, 7, 1), count)


def _words(text: Column) -> Column:
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\d]+", " "), " "), lambda w: w != "")


def _word_tokens(words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit("w:"), w))


def readings(value: Column) -> Column:
    """The ways a value may be read, each a list of tokens: numbers ``n:``, designations ``d:``, words ``w:``.

    Values that are none of these (placeholders, internal ids, comets) have no reading. Words split by spaces are
    also read as one.
    """
    v = _clean(value)
    bare = rf"^(?:[Nn]o\.? ?|#)?\(?{NUMBER}\)?(?:\.0+)?$"
    named = rf"^(?:[Nn]o\.? ?|#)?\(?({NUMBER})\)? +([\p{{L}}][\p{{L}}'\-. ]{{2,}})$"
    designation = r"^[12][\dO]{3}[\s_\-]*[A-Za-z]{2}[\s_\-]*[\dO]*$"
    packed = r"^[IJK]\d\d[A-Z][0-9A-Za-z]\d[A-Z]$"
    word = r"^\p{L}[\p{L}'\-. ]*(?:\d[\p{L}'\-. ]+){0,2}$"
    words = _words(v)
    number = F.regexp_replace(v, r"\.0+$", "")
    return (
        F.when(v.rlike(bare), F.when(_number(number) != "n:", F.array(F.array(_number(number)))))
        .when(v.rlike(designation), F.array(F.array(_designation(v))))
        .when(v.rlike(packed), F.array(F.array(_packed(v))))
        .when(v.rlike(named), F.array(F.concat(F.array(_number(F.regexp_extract(v, named, 1))), _word_tokens(_words(F.regexp_extract(v, named, 2))))))
        .when(
            v.rlike(word) & (F.size(words) > 0),
            F.array_distinct(F.array(_word_tokens(words), F.array(F.concat(F.lit("w:"), F.array_join(words, ""))))),
        )
    )


def catalogue_forms(catalogue: DataFrame, entry: str, number: str, name: str, aliases: str) -> DataFrame:
    """All complete ways to write each entry: ``entry, form, tokens``."""
    c = catalogue.where(F.col(entry).isNotNull())
    numbered, named = _number(F.col(number)), _word_tokens(_words(F.col(name)))
    written_names = F.array_distinct(F.concat(F.array(F.col(entry)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))
    forms = F.concat(
        F.transform(F.filter(written_names, lambda d: d.isNotNull()), lambda d: F.array(_designation(d))),
        F.when(F.col(number).isNotNull(), F.array(F.array(numbered))).otherwise(F.array()),
        F.when(F.size(named) > 0, F.array(named, F.array(F.concat(F.lit("w:"), F.array_join(_words(F.col(name)), ""))))).otherwise(F.array()),
        F.when((F.size(named) > 0) & F.col(number).isNotNull(), F.array(F.concat(F.array(numbered), named))).otherwise(F.array()),
    )
    out = c.select(F.col(entry).alias("entry"), F.explode(F.array_distinct(forms)).alias("tokens")).distinct()
    return out.select("entry", F.xxhash64("entry", "tokens").alias("form"), F.array_distinct("tokens").alias("tokens"))


def _deletions(word: Column) -> Column:
    """A word and all that is left of it after one or two deletions."""

    def cut(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    once = F.when(F.length(word) >= ONE_SLIP, cut(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when(F.length(word) >= TWO_SLIPS - 2, F.flatten(F.transform(cut(word), cut))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _thirds(word: Column, length: Column, shift: Column) -> Column:
    """The thirds of a term of ``length`` letters as they would stand in ``word``, moved by ``shift`` letters."""
    third = F.ceil(length / 3).cast("int")
    return F.array(*[
        F.concat_ws("|", length.cast("string"), F.lit(str(k)), F.substr(word, F.greatest(F.lit(1), k * third + 1 + shift), F.least(third, length - k * third)))
        for k in range(3)
    ])


def _keys(word: Column, of_term: bool) -> Column:
    """Keys that a term and any word within two edits of it share.

    Terms of up to ``LONG`` letters share a deletion variant. Of longer ones two edits leave one third whole, moved
    by at most two letters; so the number of keys of a word does not grow with its length.
    """
    n, none = F.length(word), F.array().cast("array<string>")
    steps = [F.lit(0)] if of_term else [F.lit(k) for k in (-2, -1, 0, 1, 2)]
    short = F.when(n <= (LONG if of_term else LONG + 2), _deletions(word)).otherwise(none)
    thirds = [F.when(n + by > LONG, _thirds(word, n + by, shift)).otherwise(none) for by in steps for shift in steps]
    return F.array_distinct(F.concat(short, *thirds))


def repaired(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct tokens joined to the vocabulary: ``token, term, sim``.

    Tokens in the vocabulary stand for themselves. Other words go to the terms within 1 (from 4 letters) or 2
    (from 8 letters) edits, found through shared keys and kept by exact edit distance, of which the nearest count.
    Numbers and designations are never repaired: a neighbour is another object. Words of any length are compared.
    """
    exact = tokens.join(vocabulary.select(F.col("term").alias("token")), "token", "left_semi")
    rest = tokens.join(vocabulary.select(F.col("term").alias("token")), "token", "left_anti").where(F.col("token").startswith("w:"))
    left = rest.select("token", F.explode(_keys(F.substr("token", F.lit(3)), False)).alias("variant"))
    right = vocabulary.where(F.col("term").startswith("w:")).select("term", F.explode(_keys(F.substr("term", F.lit(3)), True)).alias("variant"))
    shorter = F.least(F.length("token"), F.length("term")) - 2
    allowed = F.when(F.greatest(F.length("token"), F.length("term")) - 2 >= TWO_SLIPS, 2).when(shorter >= ONE_SLIP, 1).otherwise(0)
    # Sizes before the explode would mislead into a broadcast.
    met = left.join(right.hint("merge"), "variant").select("token", "term").distinct()
    edits = met.withColumn("edits", F.levenshtein("token", "term", 2)).where(F.col("edits").between(0, allowed))
    near = edits.withColumn("nearest", F.min("edits").over(Window.partitionBy("token"))).where("edits = nearest")
    sim = F.lit(1.0) - F.col("edits") / (F.greatest(F.length("token"), F.length("term")) - 2)
    return exact.select("token", F.col("token").alias("term"), F.lit(1.0).alias("sim")).unionByName(near.select("token", "term", sim.alias("sim")))


def canonical(values: DataFrame, value: str, catalogue: DataFrame, entry: str, number: str, name: str, aliases: str, least_score: float = 0.6) -> DataFrame:
    """The catalogue entry of each distinct value: ``value, entry, score``; entry is ``UNMATCHED`` if there is none.

    Values are read as tokens, each distinct token is repaired against the tokens of the catalogue, and complete
    forms of entries (number, name, number with name, each designation) are ranked by the soft TF-IDF cosine of
    the repaired tokens, whose weights fall with the share of entries that have them; the best form of at least ``least_score`` wins, among equals the smallest entry. Tokens in
    no form take part in the norm, so an unknown word or number beside a known one lowers the score. A token counts
    for one term of a form and a term for one token, so no score is above 1.

    Each value is treated once, however many rows have it. Null values give no row; a catalogue without rows leaves
    all unmatched; null numbers, names, aliases of an entry are ways of writing it does not have. The catalogue's
    weighted forms and the values' tokens are written once and read by all joins, which choose their strategy by
    size: neither side is assumed small.
    """
    distinct = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    read = distinct.select("value", F.posexplode(readings(F.col("value"))).alias("reading", "tokens"))
    used = written(read.select("value", "reading", F.explode(F.array_distinct("tokens")).alias("token")), "tokens").df
    forms = written(catalogue_forms(catalogue, entry, number, name, aliases), "forms").df
    n_entries = F.lit(float(forms.agg(F.count_distinct("entry")).first()[0]))
    form_terms = forms.select("entry", "form", F.explode("tokens").alias("term"))
    idf = form_terms.groupBy("term").agg(F.log(F.lit(1.0) + n_entries / F.count_distinct("entry")).alias("idf"))
    weights = written(idf, "weights").df
    by_form = Window.partitionBy("entry", "form")
    weighted = form_terms.join(weights, "term").withColumn("form_norm", F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(by_form)))
    weighted = written(weighted, "weighted-forms").df
    fixed = written(repaired(used.select("token").distinct(), weights.select("term")).join(weights, "term"), "repaired").df
    rare = F.log(F.lit(1.0) + n_entries)  # the weight of a token that no form has
    own = used.join(fixed.groupBy("token").agg(F.max("idf").alias("w")), "token", "left")
    own_norm = own.groupBy("value", "reading").agg(F.sqrt(F.sum(F.coalesce(F.col("w") * F.col("w"), rare * rare))).alias("value_norm"))
    met = used.join(fixed.select("token", "term", "sim"), "token").join(weighted, "term")
    # One exchange serves the three steps: a token's best term, a term's best token, and their sum.
    met = met.select("value", "reading", "entry", "form", "form_norm", "token", "term", (F.col("idf") * F.col("idf") * F.col("sim")).alias("x")).repartition("value", "reading")
    met = met.groupBy("value", "reading", "entry", "form", "form_norm", "token").agg(F.max(F.struct("x", "term")).alias("b"))
    met = met.groupBy("value", "reading", "entry", "form", "form_norm", F.col("b.term").alias("term")).agg(F.max("b.x").alias("x"))
    scored = met.groupBy("value", "reading", "entry", "form", "form_norm").agg(F.sum("x").alias("dot")).join(own_norm, ["value", "reading"])
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("form_norm") * F.col("value_norm")), 9)).where(F.col("score") >= least_score)
    best = scored.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry")).alias("b"))
    out = distinct.join(best, "value", "left")
    return out.select("value", F.coalesce("b.entry", F.lit(UNMATCHED)).alias("entry"), (-F.col("b.s")).alias("score"))


def canonical_by_part(df: DataFrame, value: str, part: str, catalogue: DataFrame, entry: str, number: str, name: str, aliases: str) -> DataFrame:
    """:func:`canonical` for each distinct (``value``, ``part``): ``value, part, entry``."""
    pairs = df.select(value, part).where(F.col(value).isNotNull()).distinct()
    found = canonical(pairs, value, catalogue, entry, number, name, aliases).select(F.col("value").alias(value), F.col("entry").alias(entry))
    return pairs.join(found, value).select(value, part, entry)
