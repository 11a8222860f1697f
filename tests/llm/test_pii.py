import random
import re

import pytest
from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import pii, scratch

KEY = "a test's key"


def replaced(spark, texts, **more):
    got = pii.pseudonymise(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), KEY, **more).collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)]


def test_personal_data(spark):
    texts = [None, "", "no data here v1.2.3.4.5", "Mail JOE@x.com and joe@x.com", "Mr. John Smith, Frau Müller", "call +1 (487) 555-7209 or 10.2.3.4", "4111 1111 1111 1111 / 4111-1111-1111-1111"]
    got = [r.text for r in pii.pseudonymise(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), KEY).orderBy("doc_id").collect()]
    assert got[:3] == texts[:3]
    mails = re.findall(r"\S+@\S+", got[3])
    assert len(set(mails)) == 1 and mails[0].endswith(".example")
    assert re.fullmatch(r"Mr\. [A-Z][\w-]+ [A-Z]\w+, Frau [A-Z]\w+", got[4]) and "Smith" not in got[4]
    assert re.fullmatch(r"call \+1 \(\d{3}\) 555-\d{4} or 10\.\d+\.\d+\.\d+", got[5]) and "7209" not in got[5]
    a, b = got[6].split(" / ")
    assert a.replace(" ", "") == b.replace("-", "") != "4111111111111111"


def test_personal_data_spelled_with_and_without_separators(spark):
    groups = [
        ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
        ["(487) 555-7209", "487-555-7209", "487.555.7209"],
        ["+1 (487) 555-7209", "+14875557209", "+1 487 555 7209", "+1-487-555-7209"],
        ["+49 30 1234 5678", "+493012345678", "+49 301 234 5678"],
    ]
    rows = [(10 * g + k, f"see {m}", "a") for g, mentions in enumerate(groups) for k, m in enumerate(mentions)]
    got = {r.doc_id: r.text[4:] for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    plain = lambda t: re.sub("[^A-Z0-9]", "", t)
    seen = set()
    for g, mentions in enumerate(groups):
        made = [got[10 * g + k] for k in range(len(mentions))]
        assert len({plain(m) for m in made}) == 1 and plain(made[0]) != plain(mentions[0]), made
        assert [re.sub("[A-Z0-9]", "#", m) for m in made] == [re.sub("[A-Z0-9]", "#", m) for m in mentions]
        seen.add(plain(made[0]))
    assert len(seen) == len(groups) and got[10][:2] == "DE" and all(re.fullmatch(r"1\d{3}555\d{4}", plain(got[30 + k])) for k in range(4)) and got[41][:3] == "+49"


def test_names_of_one_person(spark):
    text = "Mr. John Smith said. John Smith left. Mr. Smith. SMITH's car, Dr. John Smith. Mr. O'Brien's hat; O'Brien. Johnny Smithson and john smith stay."
    got = replaced(spark, [text, "Господин Иван Петров и Иван; Госпожа Петрова", "John Smith without a title stays", "Mr. A" + "b" * 60 + " end"])
    m = re.fullmatch(r"Mr\. (\S+) (\S+) said\. (\S+) (\S+) left\. Mr\. (\S+)\. (\S+)'s car, Dr\. (\S+) (\S+)\. Mr\. (\S+)'s hat; (\S+)\. Johnny Smithson and john smith stay\.", got[0])
    assert m and len({m[1], m[3], m[7]}) == 1 and len({m[2], m[4], m[5], m[6], m[8]}) == 1 and m[9] == m[10] != m[2]
    assert m[1].split("-")[0] in pii.NAMES["m", "latin"] and not re.search("John |Smith |O'Brien", got[0].replace("Johnny", ""))
    m = re.fullmatch(r"Господин (\S+) (\S+) и (\S+); Госпожа (\S+)", got[1])
    assert m and m[1] == m[3] and m[1].split("-")[0] in pii.NAMES["m", "cyrillic"] and re.fullmatch("[А-я]+", m[2])
    assert got[2] == "John Smith without a title stays" and re.fullmatch(r"Mr\. [A-Z][a-z]+ end", got[3]) and "bb" not in got[3]


def test_check_digits(spark):
    def luhn(t):
        d = [int(c) for c in re.sub("[^0-9]", "", t)][::-1]
        return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10

    def mod97(t):
        t = re.sub("[^A-Z0-9]", "", t)
        return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97

    cards, accounts = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    got = replaced(spark, cards + accounts)
    assert all(luhn(t) == 0 and t != c for t, c in zip(got[:3], cards)) and all(mod97(t) == 1 and t[:2] == c[:2] and t != c for t, c in zip(got[3:], accounts)), got


def test_addresses_share_their_domain(spark):
    a, b, c = re.findall(r"\S+@\S+", replaced(spark, ["ann@acme.com bob@Acme.com ann@mail.acme.co.uk", "x" * 80 + "@acme.com"])[0])
    assert a.split("@")[1] == b.split("@")[1] != c.split("@")[1] and len({a, b, c}) == 3


def test_gate_is_implied_by_every_pattern(spark):
    """An entity is found alone as it is beside others."""
    alone = ["DE89 ABCD EFGH IJKL", "10.2.3.4", "078-05-1120", "(20) 123 4567", "+49 30 1234", "487.555.7209", "1234 5678 9012 3", "4222222222222", "555 234 5678", "2001:db8::7", "1:2:3:4:5:6:7:8", "DE89370400440532013000", "a@b.co", "Mr. Bo"]
    got = replaced(spark, alone + [f"{t} and joe@x.com" for t in alone])
    for t, x, y in zip(alone, got, got[len(alone):]):
        assert x != t and y.startswith(x + " and "), (t, x, y)


def test_small_range_is_drawn_again_until_distinct(spark, monkeypatch):
    """More names than the first range holds: forms get longer, all stay distinct, and mentions agree."""
    monkeypatch.setattr(pii, "SYLLABLES", ("ba", "be"))
    r = random.Random(1)
    names = sorted({"".join(r.choice("abcdefghij") for _ in range(8)).capitalize() for _ in range(120)})
    texts = [f"Mr. {n} and Frau {n}" for n in names]
    got = [re.fullmatch(r"Mr\. (\w+) and Frau (\w+)", t) for t in replaced(spark, texts)]
    assert all(m and m[1] == m[2] for m in got) and len({m[1] for m in got}) == len(names) > 16


def test_full_range_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", ("ba",))
    monkeypatch.setattr(pii, "ROUNDS", 12)
    with pytest.raises(ValueError):
        replaced(spark, [f"Mr. N{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)])


def test_surrogates_avoid_real_values(spark):
    first = replaced(spark, ["Mr. Smithers"])[0].split()[1]
    both = replaced(spark, ["Mr. Smithers", f"Mr. {first}"])
    assert both[0] != f"Mr. {first}" and both[1] not in (f"Mr. {first}", both[0])


def test_odd_rows(spark):
    df = clashing(docs(spark, [*ODD, (9, "joe@x.com", "a"), (9, "joe@x.com", "a")]), "of", "words", "pattern", "found", "made", "attempts", "new", "h1", "value")
    got = pii.pseudonymise(df, KEY)
    assert got.columns == df.columns and got.count() == len(ODD) + 2
    rows = got.filter("doc_id = 9").collect()
    assert rows[0] == rows[1] and rows[0].n_chars == len(rows[0].text) and rows[0].found == "own found"
    assert got.filter("doc_id = 3").first().text == "word " * 30000 and got.filter("doc_id = 1").first().text is None
    assert pii.pseudonymise(df.filter("false"), KEY).isEmpty() and got.filter(F.col("text").contains("joe@")).isEmpty()


def test_nothing_clear_is_left_behind(spark):
    """After the result is there, no table in the shared folder holds a value, also where values clash and are drawn again."""
    mails = [f"user{i}@mail.de" for i in range(40)] + [f"10.{i}.{k}.7" for i in range(40) for k in range(30)]
    df = docs(spark, [(i, f"write to {m} now", "a") for i, m in enumerate(mails)])
    mark = len(scratch.made)
    got = [r.text for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]
    left = scratch.made[mark:]
    assert len(set(got)) == len(mails) and not any(m in t for m, t in zip(mails, got))
    for path in left:
        held = " ".join(str(r) for r in spark.read.parquet(path).collect())
        assert "again" in path and not any(m in held or m.split("@")[0] in held for m in mails)
    with pytest.raises(TypeError):
        pii.pseudonymise(df)


def test_addresses_in_letters_of_all_scripts(spark):
    got = replaced(spark, ["mail ünal@beispiel.de and иван@почта.рф"])[0]
    assert "ü" not in got and "nal" not in got and "иван" not in got and got.count("@") == 2


def test_bare_numbers_are_cards_by_their_check_digit(spark):
    clean = ["at 1700000000000 ms", "ISBN 9783161484100, order 1234567890123456", "4111111111111112", "in 100 200 3000 steps", "1 555 234 5678 9", "12:30:45, a::b, std::map, 1::2"]
    # an ISBN's check digit is not a card's; of these numbers none is valid as a card
    assert replaced(spark, clean) == clean
    got = replaced(spark, ["pay 4111111111111111 of 1700000000000", "378282246310005"])
    assert re.fullmatch(r"pay [1-9]\d{15} of 1700000000000", got[0]) and "4111111111111111" not in got[0] and got[1] != "378282246310005"


def test_addresses_of_sixteen_bytes_and_spaced_numbers(spark):
    same = ["2001:db8::ff00:42:8329", "2001:0DB8:0000:0000:0000:FF00:0042:8329", "2001:db8:0:0:0:ff00:42:8329"]
    got = replaced(spark, [f"from {a}, again" for a in same] + ["fe80::1 and FE80::1 and fe80::2, f:1:2:3:4:5:6:7", "call 555 234 5678 or 555-234-5678"])
    assert len(set(got[:3])) == 1 and re.fullmatch(r"from fd[0-9a-f]{2}(:[0-9a-f]{4}){7}, again", got[0])
    a, b, c = got[3].split(", ")[0].split(" and ")
    assert a == b != c and all(x.startswith("fd") for x in (a, c)) and got[3].split(", ")[1].startswith("fd")
    m = re.fullmatch(r"call (\d{3}) (\d{3}) (\d{4}) or (\d{3})-(\d{3})-(\d{4})", got[4])
    assert m and m.groups()[:3] == m.groups()[3:] and "5678" not in got[4]
