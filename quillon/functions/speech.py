"""Who speaks, and in what capacity: expressions over the text of speeches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases that mark a group's statement and a national capacity.
GROUPS = (
    "Group of Arab States|Arab Group|Arab States|European Union|Organi[sz]ation of Islamic Cooperation|OIC|"
    "League of Arab States|Movement of Non-Aligned Countries|Non-Aligned Movement|Gulf Cooperation Council|"
    "African Union|Nordic countries|Committee on the Exercise of the Inalienable Rights"
)
DELIVERS = (
    r"(?:honou?red?|pleasure|privilege)\s+to\s+(?:deliver|make|read|present|speak)"
    r"|(?:i|we)\s+(?:am\s+)?(?:deliver(?:ing)?|making|present(?:ing)?)\s+this\s+statement"
    r"|(?:i|we)\s+(?:am\s+)?(?:deliver(?:ing)?|speak(?:ing)?|address(?:ing)?)\b"
    r"|in\s+my\s+capacity\s+as\s+(?:the\s+)?chair"
)
ALIGNS = (
    "align|associat|subscrib|endors|support the statement|proposed by|submitted by|delivered by|made by|"
    "statement (?:just )?(?:made|delivered)|to be delivered"
)
NATIONAL = (
    "in my capacity as the representative|in my national capacity|speaking in my capacity as|"
    "resume my functions as president"
)
BEHALF = rf"on behalf of (?:the\s+)?({GROUPS})"
NATIONAL_PARAGRAPHS = 4


def group_of(text: Column) -> Column:
    """The first group that a text is delivered for, or null: the words of the
    sentence before ``on behalf of`` must say that the speaker delivers, and must
    not say that they join somebody else's statement."""
    behalf = F.lit(f"(?i){BEHALF}")

    def named(sentence: Column) -> Column:
        told, names = F.regexp_extract_all(sentence, behalf, F.lit(0)), F.regexp_extract_all(sentence, behalf, F.lit(1))
        around = F.split(sentence, f"(?i){BEHALF}", -1)
        steps = F.when(F.size(names) > 0, F.sequence(F.lit(0), F.size(names) - 1)).otherwise(F.array().cast("array<int>"))

        # What stands before match k: the stretches up to it and the earlier matches between them.
        head = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.concat(F.when(i > 0, F.get(told, i - 1)).otherwise(""), F.get(around, i))), "")
        fits = F.filter(steps, lambda k: head(k).rlike(f"(?i){DELIVERS}") & ~head(k).rlike(f"(?i){ALIGNS}"))
        return F.transform(fits, lambda k: F.get(names, k))

    return F.get(F.flatten(F.transform(F.split(text, "[.!?]", -1), named)), F.lit(0))


def in_national_capacity(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){NATIONAL}"), F.lit(False))


def speaker_class(role: Column, is_party: Column, for_group: Column, bloc: Column, national: Column, country: Column) -> Column:
    """Seven branches in this order; a null country counts as named, as a blank does not."""
    stated = F.coalesce(F.trim(country), F.lit("null")) != ""
    return (
        F.when(role == "official/briefer", "briefer")
        .when(is_party == 1, "party")
        .when(for_group, "group_rep")
        .when(bloc == "OBSERVER", "other_invitee")
        .when((role == "president") & national, "member_state")
        .when(role == "president", "presiding")
        .when((role == "representative") & stated, "member_state")
        .otherwise("other_invitee")
    )


def country_key(name: Column) -> Column:
    """A country's name without accents and curly apostrophes, for look-ups."""
    folded = F.translate(F.trim(name), ACCENTED, PLAIN)
    return F.replace(folded, F.lit("’"), F.lit("'"))


# Latin letters with accents, and the letters they stand for.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿŞşĞğİŠšŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyySsGgISsZz"


def stub(name: Column) -> Column:
    """Three letters of a name that no table knows; UNK if it has none."""
    letters = F.upper(F.substring(F.regexp_replace(country_key(name), "[^A-Za-z]", ""), 1, 3))
    return F.when(F.coalesce(letters, F.lit("")) == "", "UNK").otherwise(letters)


# Titles, presiding officers, what in brackets is no country, and long names of countries.
TITLES = (
    "Mr|Mrs|Ms|Miss|Mme|M|Dr|Sir|Dame|Lord|Lady|Baroness|Prince|Princess|Sheikh|Sheikha|Archbishop|Bishop|Cardinal|"
    "Monsignor|Rabbi|Judge|Justice|President|Chief|Hon|Excellency|"
    "(?:Major |Lieutenant |Brigadier |Rear |Vice )?(?:General|Admiral)|Colonel|Captain|Commander"
)
PRESIDING = r"(?i)^The\s+(Acting\s+|Temporary\s+|Vice-)?(President|Chair(man|person)?)\b"
NO_COUNTRY = r"(?i)^\s*(spoke|continued|interpretation|in\s+(English|French|Arabic)|resumed)\b"
BODY = r"(?i)\b(Department|Office|Secretariat|Division|Programme|Agency|Commission|Committee|Fund|Organization|United Nations)\b"
SHORT_NAMES = {
    "United Kingdom of Great Britain and Northern Ireland": "United Kingdom",
    "United States of America": "United States",
    "Bolivarian Republic of Venezuela": "Venezuela",
    "Plurinational State of Bolivia": "Bolivia",
    "Kingdom of the Netherlands": "Netherlands",
    "Islamic Republic of Iran": "Iran",
    "Observer State of Palestine": "State of Palestine",
}


def split_header(text: Column, prefix: Column | None = None, longest: int = 220) -> Column:
    """struct(header, body) of a paragraph that opens a turn, else null. The
    header ends at a colon; where the record drops it, behind the brackets that
    follow the bold ``prefix``. It must be as long as the prefix, and read like a
    person with a title or a presiding officer. Without ``prefix`` any paragraph
    with a colon is tried."""
    at = F.call_function("locate", F.lit(":"), text)
    colon = (at > 0) & (at <= longest + 1)
    head, body = F.trim(text.substr(F.lit(1), at - 1)), F.trim(text.substr(at + 1, F.length(text)))
    bold = F.lit(True)
    if prefix is not None:
        bold = F.coalesce(prefix, F.lit("")) != ""
        rest = F.substring(text, F.length(F.trim(prefix)) + 1, F.length(text))
        brackets = F.regexp_extract(rest, r"^\s*((?:\([^()]*\)\s*)+)", 0)
        found = text.startswith(F.trim(prefix)) & (brackets != "")
        cut = F.length(F.trim(prefix)) + F.length(brackets)
        head = F.when(colon, head).when(found, F.trim(text.substr(F.lit(1), cut)))
        body = F.when(colon, body).when(found, F.trim(text.substr(cut + 1, F.length(text))))
        bold = bold & (F.length(head) >= F.length(F.rtrim(F.regexp_replace(prefix, "[ :]+$", ""))) - 2)
    else:
        head = F.when(colon, head)
    name = F.trim(F.regexp_replace(head, r"\([^()]*\)", ""))
    person = name.rlike(PRESIDING) | name.rlike(r"(?i)^The Secretary-General\b") | name.rlike(rf"^(?:{TITLES})\b\.?\s+\S")
    return F.when(bold & person, F.struct(head.alias("header"), body.alias("body")))


def header_of(text: Column, longest: int = 220) -> Column:
    """The speaker's header of a paragraph without layout."""
    return split_header(text, None, longest)["header"]


def surname(person: Column) -> Column:
    """A name without its title."""
    plain = F.regexp_replace(F.regexp_replace(person, r"\s+", " "), r"^[ .,]+|[ .,]+$", "")
    return F.trim(F.regexp_replace(plain, rf"^(?:{TITLES})\.?\s+", ""))


def speaker_of(header: Column, chair_country: Column | None = None, roster_country: Column | None = None, chair_name: Column | None = None) -> Column:
    """A struct of name, country, language, role and notes. Of the brackets, one says the
    language, and the first that is neither a note nor a UN body the country; a
    presiding officer's country comes from the cover, others' from the roster; The
    President is called by the cover's name. Other brackets are notes."""
    inside = F.transform(F.regexp_extract_all(header, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(header, r"\([^()]*\)", ""), r"\s+", " "), r"^[ ,;:]+|[ ,;:]+$", "")
    spoken = F.filter(F.transform(F.filter(inside, lambda p: p.rlike(NO_COUNTRY)), lambda p: F.regexp_extract(p, "(?i)spoke in ([A-Za-z]+)", 1)), lambda x: x != "")
    named = F.get(F.filter(inside, lambda p: (p != "") & ~p.rlike(NO_COUNTRY) & ~p.rlike(BODY)), F.lit(0))
    presides = name.rlike(PRESIDING)
    none = F.lit(None).cast("string")
    given = F.coalesce(named, F.when(presides, chair_country if chair_country is not None else none), roster_country if roster_country is not None else none, F.lit(""))
    bare = F.regexp_replace(given, r"\s*\.\s*(Minister|Deputy|President|Prime|Secretary|Ambassador).*$", "")
    bare = F.regexp_replace(bare, r"^[ .,]+|[ .,]+$", "")
    short = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    country = F.coalesce(F.try_element_at(short, bare), bare)
    role = F.when(presides, "president").when(country != "", "representative").otherwise("official/briefer")
    language = F.coalesce(F.get(spoken, F.size(spoken) - 1), F.when(role == "official/briefer", "").otherwise("English"))
    # Brackets that say neither the country nor nothing: in their order.
    is_country = lambda p: ~p.rlike(NO_COUNTRY) & ~p.rlike(BODY)
    said = F.filter(inside, lambda p: p != "")
    marked = F.transform(said, lambda p, i: F.when(is_country(p) & (F.size(F.filter(F.slice(said, 1, i), is_country)) == 0), F.lit(None)).otherwise(p))
    notes = F.array_join(F.filter(marked, lambda p: p.isNotNull()), "; ")
    if chair_name is not None:
        name = F.when(name.rlike("(?i)^The President$") & (F.coalesce(chair_name, F.lit("")) != ""), chair_name).otherwise(name)
    return F.struct(name.alias("name"), country.alias("country"), language.alias("language"), role.alias("role"), notes.alias("notes"))


# Names of states, without accents, and their codes.
ISO3 = {
    "Albania": "ALB", "Algeria": "DZA", "Argentina": "ARG", "Armenia": "ARM", "Australia": "AUS", "Austria": "AUT", "Bahrain": "BHR", "Bangladesh": "BGD",
    "Belgium": "BEL", "Bolivia": "BOL", "Brazil": "BRA", "Brunei Darussalam": "BRN", "Cabo Verde": "CPV", "Cambodia": "KHM", "Cameroon": "CMR", "Canada": "CAN",
    "Chile": "CHL", "China": "CHN", "Colombia": "COL", "Croatia": "HRV", "Cuba": "CUB", "Czechia": "CZE", "Denmark": "DNK", "Ecuador": "ECU",
    "Egypt": "EGY", "Finland": "FIN", "France": "FRA", "Gabon": "GAB", "Germany": "DEU", "Ghana": "GHA", "Greece": "GRC", "Guatemala": "GTM",
    "Guyana": "GUY", "Holy See": "VAT", "Hungary": "HUN", "Iceland": "ISL", "India": "IND", "Indonesia": "IDN", "Iran": "IRN", "Iraq": "IRQ",
    "Ireland": "IRL", "Israel": "ISR", "Italy": "ITA", "Jamaica": "JAM", "Japan": "JPN", "Jordan": "JOR", "Kazakhstan": "KAZ", "Kuwait": "KWT",
    "Kyrgyzstan": "KGZ", "Lao People's Democratic Republic": "LAO", "Lebanon": "LBN", "Libya": "LBY", "Liechtenstein": "LIE", "Luxembourg": "LUX",
    "Malaysia": "MYS", "Maldives": "MDV", "Malta": "MLT", "Mauritania": "MRT", "Mexico": "MEX", "Morocco": "MAR", "Mozambique": "MOZ", "Namibia": "NAM",
    "Netherlands": "NLD", "New Zealand": "NZL", "Nicaragua": "NIC", "Nigeria": "NGA", "Norway": "NOR", "Oman": "OMN", "Pakistan": "PAK",
    "Palestine": "PSE", "Panama": "PAN", "Peru": "PER", "Philippines": "PHL", "Poland": "POL", "Portugal": "PRT", "Qatar": "QAT",
    "Republic of Korea": "KOR", "Romania": "ROU", "Russian Federation": "RUS", "Saint Lucia": "LCA", "Saudi Arabia": "SAU", "Senegal": "SEN",
    "Serbia": "SRB", "Sierra Leone": "SLE", "Slovenia": "SVN", "Somalia": "SOM", "South Africa": "ZAF", "Spain": "ESP", "Sri Lanka": "LKA",
    "Switzerland": "CHE", "Syrian Arab Republic": "SYR", "Thailand": "THA", "Timor-Leste": "TLS", "Trinidad and Tobago": "TTO", "Tunisia": "TUN",
    "Turkiye": "TUR", "Uganda": "UGA", "Ukraine": "UKR", "United Arab Emirates": "ARE", "United Kingdom": "GBR",
    "United States": "USA", "Venezuela": "VEN", "Viet Nam": "VNM", "Yemen": "YEM",
}
#: Equality that sees no accents: letters are as their base letters.
ACCENTLESS = "UNICODE_AI"
#: Letters that a collation reads as others, though they have no accent to take off.
STROKED = "łŁđĐøØħĦŧŦ"


def folded(name: Column) -> Column:
    """A name's plain letters: of each sign the letter that equals it under the
    collation; signs without one stay."""
    letters = F.array(*[F.lit(chr(c)) for r in (range(65, 91), range(97, 123)) for c in r])
    plain = F.split(F.replace(F.trim(name), F.lit("’"), F.lit("'")), "")

    def base(c: Column) -> Column:
        found = F.get(F.filter(letters, lambda x: F.collate(x, ACCENTLESS) == F.collate(c, ACCENTLESS)), F.lit(0))
        return F.when(c.rlike("^[\\x00-\\x7f]$") | c.isin(*STROKED), c).otherwise(F.coalesce(found, c))

    return F.array_join(F.transform(plain, base), "")


def with_iso3(df: DataFrame, name: str, to: str = "iso3", codes: dict[str, str] = ISO3) -> DataFrame:
    """``df`` with the code of each name: the stated one, joined under a collation
    that sees no accents; else a stub of its first three letters, UNK if it has none."""
    known = df.sparkSession.createDataFrame(list(codes.items()), "_state string, _code string")
    key = F.translate(F.replace(F.trim(F.col(name)), F.lit("’"), F.lit("'")), STROKED, "\u0001" * len(STROKED))
    found = df.join(F.broadcast(known), F.collate(key, ACCENTLESS) == F.collate(F.col("_state"), ACCENTLESS), "left")
    short = F.upper(F.substring(F.regexp_replace(folded(F.col(name)), "[^A-Za-z]", ""), 1, 3))
    rest = F.when(F.coalesce(short, F.lit("")) == "", "UNK").otherwise(short)
    return found.withColumn(to, F.coalesce("_code", rest)).drop("_state", "_code")
