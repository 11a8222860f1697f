"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, card and account
numbers, social security numbers and names after a title. A bare run of 13 to 19 digits is a card only if its check digit is right: times in milliseconds,
ISBNs and order numbers stay. In a text with titled names, each word of these names is an
entity wherever it stands there, with or without a title. An entity is made of values, and each value gets a surrogate that depends on
a key and the value alone, so that all mentions of a value in the corpus agree, whatever their spelling of case or spacing:

- a number is one value. Digits are drawn by their place among its letters and digits, so that separators, lengths and country codes stay and all
  spellings agree; the exchange 555 of numbers reserved for fiction stays; leading digits other than 0 stay so; valid check digits of cards (Luhn) and accounts (modulo 97) are
  valid again;
- an IPv4 address moves into 10.0.0.0/8, an IPv6 address into fd00::/8; all spellings of an IPv6 address agree, and its surrogate is written in full;
- an e-mail address is a local part and a domain: addresses of one domain share a domain under `example`, with as many labels or three;
- a name is a given name and a family name: the same family name has the same surrogate in "Mr. John Smith", "Mr. Smith" and
  "John Smith". Given names keep the gender of the title (of a title without gender: that of another title in the text before the same name), and script (Latin, Cyrillic).

Distinct values must keep distinct surrogates: the distinct values of the whole corpus are gathered with
their surrogates, and those whose surrogate is shared, or is itself a value in the corpus, are drawn
again (a counter goes into the key, and with it forms get longer or ranges wider) until none is; should a range ever be full, it is an error after ROUNDS. The few redrawn values are joined back to the texts that
hold them; all others get theirs in the row.

A text of any length is searched whole, in one row. Equal values have one surrogate, so there are no ties. Null texts stay null, empty ones empty; texts without entities come back unchanged; n_chars is counted anew where
a text changed; rows may repeat; an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.llm import scratch
from galleyworks.llm.scratch import materialise, small_side
from galleyworks.llm.textkit import free_name

# Patterns, titles and names.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}(?![\p{L}\p{N}-])"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?={GROUP}+:)(?<![\w:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:[23][0-9A-Fa-f]{{3}}|[fF][c-eC-E][0-9A-Fa-f]{{2}})(?::{GROUP}){{0,6}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![\w:])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<!\d )(?<![\w.,-])[2-9]\d{2} [2-9]\d{2} \d{4}(?![\w-]| \d)"
CARD = r"(?<![\w.-])\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}(?![\w-])|(?<![\w.])\d{13,19}(?!\w)"
BARE = r"^\d{13,19}$"
IBAN = r"(?=[A-Z]{2}\d)(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
MALE = "Mr|Herr|Monsieur|Señor|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа"
NEUTRAL = "Dr|Prof"
TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.?\x20"
#: What titles begin with, and all other entities contain at first, so that most places of a text are settled by one look.
TITLE_BEGIN = "(?=[" + "".join(sorted({w[0] for w in f"{FEMALE}|{MALE}|{NEUTRAL}".split("|")})) + "])"
WORD = r"(?=\p{Lu}[\p{L}'’-])\p{Lu}\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
NAME = rf"{TITLE_BEGIN}(?<!\w){TITLE}{WORD}(?:\x20{WORD})?"
#: Most places of a text are settled by a look at the sign there, before any look at those in front of it.
NUMBER = rf"(?=[0-9+(])(?:{IPV4}|{SSN}|{PHONE}|{CARD})"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, NUMBER, IPV6, IBAN, NAME))
#: What every entity but a name has, and what every name has; cheap to look for.
HINT = r"(?=[@0-9)+A-Z:])(?:@|:[0-9A-Fa-f]{0,4}:|\d{3} \d{3} \d{4}|\d[.-]\d|\)[ .-]?\d{3}|\+\d|\d{4} \d{4}|\d{13}|[A-Z]{2}\d{2})"
TITLED = rf"{TITLE_BEGIN}{TITLE}\p{{Lu}}"
NAMES = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"),
    ("n", "latin"): ("Alex", "Andy", "Ariel", "Chris", "Dana", "Jo", "Kim", "Lee", "Lou", "Mika", "Nic", "Pat", "Robin", "Sam", "Toni", "Val"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Павел"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
    ("n", "cyrillic"): ("Валя", "Женя", "Паша", "Саша", "Слава", "Шура"),
}
SYLLABLES = tuple(c + v for c in "bdfghjklmnprstvz" for v in "aeiou")
SYLLABLES_CYRILLIC = tuple(c + v for c in "бвгджзклмнпрстфх" for v in "аеиоу")

#: What may stand between the letters and digits of a number; country codes of telephone numbers and of accounts, which stay.
SEPARATORS = " .()+-"
KEPT = r"^(?:\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|([A-Z]{2})(?=\d))"
ACCOUNT = r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"

#: Draws of a value after which a range counts as full.
ROUNDS = 200


def kind_of(found: Column) -> Column:
    """What a mention is; `plain` for a bare number that is no card, which stays as it is."""
    return (
        F.when(found.contains("@"), "email").when(found.rlike(rf"^{TITLE}"), "name").when(found.contains(":"), "ipv6").when(found.rlike(BARE) & (luhn(F.filter(F.split(found, ""), lambda c: c != "")) != 0), "plain").when(found.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4").when(found.rlike(r"^\p{Lu}"), F.when(found.rlike(rf"^(?:{IBAN})$"), "number").otherwise("word")).otherwise("number")
    )


def gender(found: Column) -> Column:
    return F.when(found.rlike(rf"^(?:{FEMALE})\.?\x20"), "f").when(found.rlike(rf"^(?:{MALE})\.?\x20"), "m").otherwise("n")


def name_words(found: Column) -> Column:
    """From the mentions of a text: (order, word, value) of every given and family name after a title, those of known gender first."""
    titled = F.filter(found, lambda m: m.rlike(rf"^{TITLE}"))
    plain = F.transform(titled, lambda m: F.struct(gender(m).alias("g"), F.split(F.lower(F.regexp_replace(m, rf"^{TITLE}", "")), " ").alias("w")))

    def both(p: Column) -> Column:
        order = F.when(p["g"] == "n", 1).otherwise(0)
        family = F.struct(order.alias("order"), F.element_at(p["w"], -1).alias("word"), F.concat(F.lit("family:"), F.element_at(p["w"], -1)).alias("value"))
        given = F.struct(order.alias("order"), p["w"][0].alias("word"), F.concat(F.lit("given:"), p["g"], F.lit(":"), p["w"][0]).alias("value"))
        return F.when(F.size(p["w"]) > 1, F.array(family, given)).otherwise(F.array(family))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(plain, both))))


def pattern_of(names: Column) -> Column:
    """The pattern of all entities of a text, whose titled names are known."""
    spelled = F.array_distinct(F.transform(names, lambda n: n["word"]))
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_])(?=\p{Lu})(?iu:"), F.array_join(spelled, "|"), F.lit(r")(?![\p{L}\p{N}_])"))


def entities(found: Column, names: Column) -> Column:
    """Mentions as structs (found, kind, v1, v2: their values); names: name_words of the text."""
    kinds = F.transform(found, lambda m: F.struct(m.alias("found"), kind_of(m).alias("kind")))

    def looked_up(word: Column, start: str) -> Column:
        return F.get(F.filter(names, lambda n: (n["word"] == word) & n["value"].startswith(start)), F.lit(0))["value"]

    def valued(e: Column) -> Column:
        m, kind = e["found"], e["kind"]
        words = F.split(F.lower(F.regexp_replace(m, rf"^{TITLE}", "")), " ")
        v1 = (
            F.when(kind == "email", F.concat(F.lit("local:"), F.lower(m)))
            .when(kind == "name", F.when(F.size(words) > 1, looked_up(words[0], "given:")))
            .when(kind == "word", F.coalesce(looked_up(F.lower(m), "family:"), looked_up(F.lower(m), "given:")))
            .when(kind == "ipv4", F.concat(F.lit("ipv4:"), m))
            .when(kind == "ipv6", F.concat(F.lit("ipv6:"), written_out(m)))
            .when(kind == "plain", F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("number:"), F.upper(F.regexp_replace(m, r"(?!^\+)[^A-Za-z0-9]", ""))))
        )
        v2 = F.when(kind == "email", F.concat(F.lit("domain:"), F.lower(F.regexp_extract(m, "@(.*)$", 1)))).when(kind == "name", F.concat(F.lit("family:"), F.element_at(words, -1)))
        return F.struct(m.alias("found"), kind.alias("kind"), v1.alias("v1"), v2.alias("v2"))

    return F.transform(kinds, valued)


def written_out(address: Column) -> Column:
    """An IPv6 address as eight groups of four digits."""
    half = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(F.lower(address), "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    groups = F.concat(half(0), F.array_repeat(F.lit("0"), F.greatest(8 - F.size(half(0)) - F.size(half(1)), F.lit(0))), half(1))
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")


def values_of(made: Column) -> Column:
    """The distinct values of entities()."""
    return F.array_distinct(F.filter(F.flatten(F.transform(made, lambda e: F.array(e["v1"], e["v2"]))), lambda v: v.isNotNull()))


def digest(value: Column, key: str, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), attempt.cast("string"), value), 256)


def byte(hexes: Column, i: Column) -> Column:
    """A number of 0 to 65535 from the hex digits at place i (from 0, round and round)."""
    return F.conv(F.substr(hexes, (i * 3 % 60 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def luhn(digits: Column) -> Column:
    """The sum of an array of digits modulo 10 that is 0 for a valid card."""
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def mod97(code: Column) -> Column:
    """An account's number modulo 97, its first four characters last; 1 if it is valid."""
    turned = F.filter(F.split(F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def surrogate(value: Column, hexes: Column, attempt: Column) -> Column:
    """The surrogate of a value, of its digest and of how often it was drawn before."""
    kind, body = F.substring_index(value, ":", 1), F.regexp_extract(value, "^[a-z0-9]+:(.*)$", 1)
    at = lambda i: byte(hexes, F.lit(i))
    more = F.least(attempt, F.lit(8))
    cyrillic = body.rlike(r"\p{IsCyrillic}")
    syllables = lambda n: F.when(cyrillic, _syllables(SYLLABLES_CYRILLIC, hexes, n)).otherwise(_syllables(SYLLABLES, hexes, n))
    given = F.lit(None).cast("string")
    for (g, script), names in NAMES.items():
        given = F.when(body.startswith(f"{g}:") & (cyrillic if script == "cyrillic" else ~cyrillic), pick(names, at(19))).otherwise(given)
    ipv4 = F.concat_ws(".", F.when(attempt < 4, F.lit(10)).when(attempt < 8, 240 + at(3) % 16).otherwise(1 + at(3) % 223).cast("string"), *[(at(i) % 256).cast("string") for i in range(3)])
    return (
        F.when(kind == "local", F.concat(_syllables(SYLLABLES, hexes, F.lit(3)), F.lit("."), F.substring(hexes, 41, 10)))
        .when(kind == "domain", F.concat(_syllables(SYLLABLES, hexes, 4 + more), F.lit(".example")))
        .when(kind == "given", F.concat(given, F.lit("-"), F.initcap(syllables(2 + more))))
        .when(kind == "family", F.initcap(syllables(4 + more)))
        .when(kind == "ipv4", ipv4)
        .when(kind == "ipv6", F.concat_ws(":", F.concat(F.lit("fd"), F.substring(hexes, 1, 2)), *[F.substring(hexes, 3 + 4 * i, 4) for i in range(7)]))
        .otherwise(number(body, hexes, attempt))
    )


def _syllables(words: tuple[str, ...], hexes: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: pick(words, byte(hexes, i))), "")


def number(body: Column, hexes: Column, attempt: Column) -> Column:
    """The surrogate of a number without separators (a + at its begin may be there, and stays)."""
    kept = F.when(attempt < 8, F.length(F.regexp_extract(body, KEPT, 1)) + F.length(F.regexp_extract(body, KEPT, 2))).otherwise(0)
    fiction = body.rlike(r"^\+1\d{3}555\d{3,4}$") & (attempt < 4)
    signs = F.filter(F.split(F.translate(body, "+", ""), ""), lambda c: c != "")

    def drawn(c: Column, nth: Column) -> Column:
        return (
            F.when((nth < kept) | (fiction & nth.between(4, 6)), c)
            .when(c.between("1", "9"), (byte(hexes, nth) % 9 + 1).cast("string"))
            .when(c == "0", (byte(hexes, nth) % 10).cast("string"))
            .otherwise(F.char(byte(hexes, nth) % 26 + 65))
        )

    def checked(made: Column) -> Column:
        plain = F.array_join(made, "")
        card = body.rlike(r"^\d{12,19}$") & (luhn(signs) == 0)
        short = F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0)))
        with_luhn = F.concat(F.array_join(short, ""), ((10 - luhn(F.concat(short, F.array(F.lit("0"))))) % 10).cast("string"))
        account = body.rlike(ACCOUNT) & (mod97(body) == 1)
        zeroed = F.concat(F.substring(plain, 1, 2), F.lit("00"), F.substr(plain, F.lit(5)))
        with_97 = F.concat(F.substring(plain, 1, 2), F.lpad((98 - mod97(zeroed)).cast("string"), 2, "0"), F.substr(plain, F.lit(5)))
        return F.concat(F.when(body.startswith("+"), "+").otherwise(""), F.when(card, with_luhn).when(account, with_97).otherwise(plain))

    return F.get(F.transform(F.array(F.transform(signs, drawn)), checked), F.lit(0))


def rendered(e: Column, s1: Column, s2: Column) -> Column:
    """The replacement of a mention by the surrogates of its values, in its own form."""
    found, kind = e["found"], e["kind"]
    title = F.regexp_extract(found, rf"^({TITLE})", 1)
    plain = F.translate(s1, "+", "")
    signs = F.filter(F.split(found, ""), lambda c: c != "")
    # the place of each sign among letters and digits, whatever stands between them
    laid = F.transform(signs, lambda c, i: F.when(F.lit(SEPARATORS).contains(c), c).otherwise(F.substr(plain, F.length(F.translate(F.substr(found, F.lit(1), i + 1), SEPARATORS, "")), F.lit(1))))
    return (
        F.when(kind == "email", F.concat(s1, F.lit("@"), F.when(F.size(F.split(found, r"\.")) > 2, F.when(F.regexp_extract(found, "@(.*)$", 1).rlike(r"\..*\."), "mail.").otherwise("")).otherwise(""), s2))
        .when(kind == "name", F.concat(title, F.when(s1.isNotNull(), F.concat(s1, F.lit(" "))).otherwise(""), s2))
        .when(kind == "number", F.array_join(laid, ""))
        .when(kind == "plain", found)
        .otherwise(s1)
    )


def mentions(text: Column) -> Column:
    """Mentions of the plain pattern; most texts are settled by the hints, which every entity implies."""
    return F.when(text.rlike(HINT) | text.rlike(TITLED), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def with_entities(df: DataFrame, text: str, names: tuple[str, str, str, str]) -> DataFrame:
    """df with its texts' name words, pattern, mentions and entities as columns of these names; mentions are null where there are none. Built in steps, so that each is computed once a row."""
    words, pattern, found, made = names
    df = df.withColumn(found, mentions(F.col(text)))
    df = df.withColumn(found, F.when(F.size(found) > 0, F.col(found)))
    df = df.withColumn(words, F.when(F.exists(found, lambda m: m.rlike(rf"^{TITLE}")), name_words(F.col(found))))
    df = df.withColumn(pattern, F.when(F.col(found).isNotNull(), F.coalesce(pattern_of(F.col(words)), F.lit(ENTITY))))
    df = df.withColumn(found, F.when(F.col(words).isNotNull(), F.regexp_extract_all(F.col(text), F.col(pattern), F.lit(0))).otherwise(F.col(found)))
    return df.withColumn(made, entities(F.col(found), F.coalesce(F.col(words), F.array().cast("array<struct<order:int,word:string,value:string>>"))))


def redrawn(values: DataFrame, key: str) -> DataFrame:
    """value, attempt of the values (a row for each distinct one) whose first surrogate is shared or is a value in the corpus; few or none.

    Each round draws again for those that clash, all but the least of those that share a surrogate, and never changes the others.
    """
    values = materialise(values.withColumn("attempt", F.lit(0)), "pii-values")
    for _ in range(ROUNDS):
        made = values.withColumn("hexes", digest(F.col("value"), key, F.col("attempt")))
        made = made.select("value", "attempt", F.lower(F.concat(F.regexp_extract("value", "^([a-z0-9]+:(?:[mfn]:(?=.))?)", 1), surrogate(F.col("value"), F.col("hexes"), F.col("attempt")))).alias("to"))
        made = materialise(made, "pii-drawn")
        first = made.groupBy("to").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n"))
        shared = first.filter("n > 1").select("to", F.col("first.value").alias("stays"))
        taken = values.select(F.lower("value").alias("to")).distinct().withColumn("real", F.lit(True))
        made = made.join(shared, "to", "left").join(taken, "to", "left")
        clash = F.coalesce(F.col("real"), F.lit(False)) | (F.col("stays").isNotNull() & (F.col("stays") != F.col("value")))
        again = materialise(made.filter(clash).select("value"), "pii-clashes")
        if again.isEmpty():
            return values.filter("attempt > 0").select("value", "attempt")
        values = materialise(values.join(again.withColumn("again", F.lit(1)), "value", "left").select("value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "pii-values")
    raise ValueError(f"values clash after {ROUNDS} draws: a range of surrogates is full")


def pseudonymise(documents: DataFrame, key: str, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """documents with every entity of `text` replaced, and `chars` (where there is such a column) counted anew. Who knows the key can find a value's surrogate: keep it secret.

    Tables that hold values on the way are removed when the result is returned or an error raised; the one that the result still reads has keyed hashes of values.
    """
    spark, mark, kept = documents.sparkSession, len(scratch.made), []
    try:
        return _pseudonymised(documents, key, text, chars, kept)
    finally:
        scratch.remove(spark, [p for p in scratch.made[mark:] if p not in kept])


def named(value: Column, key: str) -> Column:
    """A keyed hash of a value."""
    return F.sha2(F.concat(F.lit(f"{key}#name#"), value), 256)


def _pseudonymised(documents: DataFrame, key: str, text: str, chars: str | None, kept: list[str]) -> DataFrame:
    own = documents.columns
    words, pattern, found, made, of, attempts, new = free_name(documents, "words", "pattern", "found", "made", "of", "attempts", "new")
    # the values of each text, once for the corpus: further steps need no second search of the texts
    held = with_entities(documents.select(text), text, (words, pattern, found, made)).filter(F.col(found).isNotNull())
    held = materialise(held.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), values_of(F.col(made)).alias("values")), "pii-held")
    drawn = materialise(redrawn(held.select(F.explode("values").alias("value")).distinct(), key), "pii-redrawn")
    df = with_entities(documents, text, (words, pattern, found, made))
    attempt = lambda v: F.lit(0)
    if not drawn.isEmpty():
        # texts that hold a redrawn value find its attempt by their hash
        again = held.select("h1", "h2", F.explode("values").alias("value")).join(small_side(drawn, 100_000, 256), "value").distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct(named(F.col("value"), key).alias("value"), "attempt")).alias(attempts))
        again = materialise(again.select(F.struct("h1", "h2").alias(of), attempts), "pii-again")
        kept.append(scratch.made[-1])
        df = df.withColumn(of, F.when(F.col(found).isNotNull(), F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))).join(small_side(again, 100_000), of, "left")
        attempt = lambda v: F.coalesce(F.get(F.filter(F.col(attempts), lambda a: a["value"] == named(v, key)), F.lit(0))["attempt"], F.lit(0))

    # in steps: what a later one names more than once is computed once
    keyed = lambda e: F.struct(e["found"].alias("found"), e["kind"].alias("kind"), *[x for i in "12" for x in (e[f"v{i}"].alias(f"v{i}"), attempt(e[f"v{i}"]).alias(f"a{i}"))])
    hashed = lambda e: F.struct(e["found"].alias("found"), e["kind"].alias("kind"), *[x for i in "12" for x in (e[f"v{i}"].alias(f"v{i}"), e[f"a{i}"].alias(f"a{i}"), digest(e[f"v{i}"], key, e[f"a{i}"]).alias(f"h{i}"))])
    drawn_of = lambda e, i: F.when(e[f"v{i}"].isNotNull(), surrogate(e[f"v{i}"], e[f"h{i}"], e[f"a{i}"]))
    made_of = lambda e: F.struct(e["found"].alias("found"), e["kind"].alias("kind"), drawn_of(e, 1).alias("s1"), drawn_of(e, 2).alias("s2"))
    df = df.withColumn(new, F.transform(F.transform(F.transform(F.transform(made, keyed), hashed), made_of), lambda e: rendered(e, e["s1"], e["s2"])))
    parts = F.arrays_zip(F.split(F.col(text), F.col(pattern), -1).alias("gap"), F.col(new).alias("new"))
    whole = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    df = df.withColumn(text, F.when(F.col(found).isNotNull(), whole).otherwise(F.col(text)))
    if chars in own:
        df = df.withColumn(chars, F.coalesce(F.length(text).cast(documents.schema[chars].dataType), F.col(chars)))
    return df.select(*[F.col(f"`{c}`") for c in own])
