"""Covers and headers against plain loops."""

import random
import re

from pyspark.sql import functions as F

from quillon.functions import speech as sp
from quillon.operators import cover as cv


def surname(person):
    person = re.sub(r"\s+", " ", person).strip(" .,")
    return re.sub(rf"^(?:{sp.TITLES})\.?\s+", "", person).strip()


def plain(text):
    """The roster, line by line."""
    roster, pending = {}, ""

    def add(names, country):
        for person in names.split("/"):
            if country.strip(" .,") and surname(person):
                roster.setdefault(surname(person), country.strip(" .,"))

    if "Members:" in text:
        for line in text.split("Members:", 1)[1].split("Agenda")[0].split("\n"):
            line = re.sub(r"\s+", " ", line).strip()
            parts = re.split(r"(?:\s*[.…]){3,}", line, maxsplit=1)
            if len(parts) == 2:
                head, tail = (p.strip(" .,") for p in parts)
                if re.match(cv.PERSON, tail):
                    add(tail, head)
                    pending = ""
                else:
                    pending = head
            elif pending and re.match(cv.PERSON, line):
                add(line, pending)
                pending = ""
    flat = re.sub(r"[.…]{2,}", " ", text)
    m = re.search(cv.PRESIDENT, flat)
    if m:
        add(re.sub(r"\s+", " ", m[1]).strip(" .,"), re.sub(r"\s+", " ", m[2]).strip())
    return roster


def test_rosters_against_a_plain_loop(spark):
    r = random.Random(11)
    lines = ["Albania . . . . .", "Chad …", "Peru ... Mr. Lund", "Mr. Hoxha", "Mrs. Ash/Dr. Oak", "", "  Malta ..... Ms.  Fir . ", "Sir Elm", "Observers", "Agenda", "Norway .. Mr. Two", "Major General Yew", ". . . Mr. None", "Iran . . . . none", "Dame Lund", "Members: again ... Mr. X"]
    texts = ["".join(("President: Mr. " + r.choice(["Lund", "Pine"]) + " .....\n (Fiji)\n") * (r.random() < 0.5)) + "Members:\n" * (r.random() < 0.9) + "\n".join(r.choice(lines) for _ in range(r.randrange(12))) for _ in range(400)]
    got = cv.read_covers(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [x["roster"] for x in got] == [plain(t) for t in texts]
    assert max(len(x["roster"]) for x in got) > 3


def test_fields_of_a_cover(spark):
    text = "A/ES-10/PV. 43\n(Resumption  2)\nThursday,  7 March 2024, 3 p.m.\n101st plenary meeting\nPresident: Mr. A. Low . . . . (Trinidad\nand Tobago)\nMembers: \nChad . . . . Mr. B"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    a, b, c = cv.read_covers(rows).collect()
    assert tuple(a)[1:] == ("A/ES-10/PV. 43 (Resumption 2)", "7 March 2024", "101", "Mr. A. Low", "Trinidad and Tobago", {"B": "Chad", "A. Low": "Trinidad and Tobago"})
    assert tuple(b)[1:] == tuple(c)[1:] == ("", "", "", "", "", {})


def test_headers_without_a_colon_notes_and_the_president(spark):
    def read(text, prefix):
        h = sp.split_header(F.col("t"), F.col("p"))
        df = spark.createDataFrame([(text, prefix)], "t string, p string").select(h.alias("h"))
        df = df.select("h", sp.speaker_of(F.col("h.header"), F.lit("Chad"), None, F.lit("Mr. Lund")).alias("s"))
        r = df.first()
        return r["h"] and (r["h"]["header"], r["h"]["body"], r["s"]["name"], r["s"]["country"], r["s"]["notes"])

    assert read("Mrs. Shino (Japan) I thank you.", "Mrs. Shino ") == ("Mrs. Shino (Japan)", "I thank you.", "Mrs. Shino", "Japan", "")
    assert read("Mr. Oak (Mali) (spoke in French) (Office of Legal Affairs) (Peru) We speak", "Mr. Oak") == ("Mr. Oak (Mali) (spoke in French) (Office of Legal Affairs) (Peru)", "We speak", "Mr. Oak", "Mali", "spoke in French; Office of Legal Affairs; Peru")
    assert read("The President: I give the floor.", "The President:") == ("The President", "I give the floor.", "Mr. Lund", "Chad", "")
    assert read("The President (spoke in Arabic): Yes", "The President") == ("The President (spoke in Arabic)", "Yes", "Mr. Lund", "Chad", "spoke in Arabic")
    assert read("Mrs. Shino I thank you.", "Mrs. Shino") is None and read("Agenda item 3: more", "Agenda item 3") is None
    assert read("Mr. Oak: yes", "") is None and read("Mr. Oak: yes", "Mr. Oak and all of his many friends") is None


def test_a_cover_is_read_once(spark, sf):
    """The fold over the lines stands once in the plan, no filter before the explode repeats it, and all cores take part."""
    import __spark_entry__ as entry

    got = entry.queries()["cover_rosters"](spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count(cv.PRESIDENT) == 2 and "RepartitionByExpression" in plan
    long = "Members:\n" + "\n".join(f"Land {i} . . . . . Mr. N{i % 150}" for i in range(200))
    one = cv.read_covers(spark.createDataFrame([(long,)], "text string"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert one.first()["roster"] == plain(long) and len(plain(long)) == 150
