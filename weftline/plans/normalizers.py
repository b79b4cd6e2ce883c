"""Queries of the normalizers' passes on texts made from the tables, with the words made anew in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import normalize as N
from weftline.operators.text import mapped
from weftline.plans.registry import query
from weftline.session import spread, table

# ---- words of numbers, in SQL ----
_ONES = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"
_ORD = "['zeroth','first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth']"
_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_FI = "['nolla','yksi','kaksi','kolme','neljä','viisi','kuusi','seitsemän','kahdeksan','yhdeksän','kymmenen']"


def c99(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN ({_ONES})[{n} + 1] ELSE ({_TENS})[{n} // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN '-' || ({_ONES})[{n} % 10 + 1] ELSE '' END END"


def c999(n: str) -> str:
    return f"CASE WHEN {n} < 100 THEN {c99(n)} ELSE ({_ONES})[{n} // 100 + 1] || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' and ' || {c99(f'({n} % 100)')} ELSE '' END END"


def c999999(n: str) -> str:
    low = f"({n} % 1000)"
    return f"CASE WHEN {n} < 1000 THEN {c999(n)} ELSE {c999(f'({n} // 1000)')} || ' thousand' || CASE WHEN {low} = 0 THEN '' WHEN {low} < 100 THEN ' and ' || {c99(low)} ELSE ', ' || {c999(low)} END END"


def o99(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN ({_ORD})[{n} + 1] WHEN {n} % 10 = 0 THEN ({_TENS})[{n} // 10 + 1][:-2] || 'ieth' ELSE ({_TENS})[{n} // 10 + 1] || '-' || ({_ORD})[{n} % 10 + 1] END"


def year(n: str, oh: str = "oh-") -> str:
    return f"CASE WHEN {n} // 100 % 10 = 0 AND {n} % 100 < 10 THEN {c999999(n)} ELSE {c99(f'({n} // 100)')} || ' ' || CASE WHEN {n} % 100 = 0 THEN 'hundred' WHEN {n} % 100 < 10 THEN '{oh}' || ({_ONES})[{n} % 100 + 1] ELSE {c99(f'({n} % 100)')} END END"


def fi99(n: str) -> str:
    """Nominative up to 99, glued."""
    return f"CASE WHEN {n} <= 10 THEN ({_FI})[{n} + 1] WHEN {n} < 20 THEN ({_FI})[{n} - 9] || 'toista' ELSE ({_FI})[{n} // 10 + 1] || 'kymmentä' || CASE WHEN {n} % 10 > 0 THEN ({_FI})[{n} % 10 + 1] ELSE '' END END"


def fi9999(n: str) -> str:
    h, low = f"({n} // 100 % 10)", f"({n} % 100)"
    return (
        f"CASE WHEN {n} >= 2000 THEN ({_FI})[{n} // 1000 + 1] || 'tuhatta' WHEN {n} >= 1000 THEN 'tuhat' ELSE '' END || CASE WHEN {n} >= 1000 AND {n} % 1000 > 0 THEN ' ' ELSE '' END"
        f" || CASE WHEN {h} = 0 THEN '' WHEN {h} = 1 THEN 'sata' ELSE ({_FI})[{h} + 1] || 'sataa' END || CASE WHEN {low} > 0 OR {n} = 0 THEN {fi99(low)} ELSE '' END"
    )


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _passes(spark, d, tab, key, lang, name, text, *keys):
    cols = [key, *keys]
    return table(spark, d, tab).select(*cols, N.one_pass(text, lang, name).alias("said"))


def _register(name: str, lang: str, pass_name: str, tab: str, keys: tuple[str, ...], text, sql: str) -> None:
    """A query of one pass over texts made from a table; ``sql`` is what it should say."""
    oracle = f"SELECT {', '.join(keys)}, {sql} AS said FROM {tab}"

    @query(name, oracle)
    def run(spark, d):
        return spread(table(spark, d, tab)).select(*keys, N.one_pass(text(), lang, pass_name).alias("said"))


C, L = F.col, F.lit
_part, _line = ("p_partkey",), ("l_orderkey", "l_linenumber")

_register("en_a_metadata", "en", "metadata", "part", _part, lambda: F.concat("p_name", L(" ISBN 978-0-306-40615-7 end doi:10.1000/x"), _s("p_size"), L(" CC-BY-SA 4.0 All rights reserved.")), "p_name || '  end   '")
_register("en_b_quotes", "en", "quotes", "part", _part, lambda: F.concat(L("“"), "p_name", L("” it’s 3–4—no… wait.... "), _s("p_size")), "'\"' || p_name || '\" it''s 3-4 - no… wait'")
_register("en_r_urls", "en", "urls", "part", _part, lambda: F.concat(L("see https://a"), _s("p_size"), L(".org/x?y=1&z#t, mail u"), _s("p_size"), L("@b.com.")), "'see https a' || p_size || ' dot org slash x question y equals 1 and z hash t, mail u' || p_size || ' at b dot com.'")
_register("en_c_abbrev", "en", "abbreviations", "part", _part, lambda: F.concat(L("Dr. St. Peter vs. the U.S.A. on Main St., p. "), _s("p_size"), L(" etc. the ship.")), "'Doctor Saint Peter versus the U S A on Main Street, page ' || p_size || ' et cetera the shipage'")
_ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIV", "XIX", "XL", "XC")
_ROMAN_N = "([1,2,3,4,5,6,7,8,9,10,11,12,14,19,40,90])[p_partkey % 16 + 1]"
_roman = lambda: F.element_at(F.array(*map(F.lit, _ROMANS)), (C("p_partkey") % 16 + 1).cast("int"))
_ROMAN_S = "(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIV','XIX','XL','XC'])[p_partkey % 16 + 1]"
_register("en_d_roman", "en", "roman", "part", _part, lambda: F.concat(L("Chapter "), _roman(), L(" and Louis "), _roman(), L(" but "), _roman()), f"'Chapter ' || {c99(_ROMAN_N)} || ' and Louis the ' || {o99(_ROMAN_N)} || ' but ' || {_ROMAN_S}")
_register("en_s_acronym", "en", "acronyms", "customer", ("c_custkey",), lambda: F.when(C("c_custkey") % 3 == 0, F.concat(L("the FBI and NASA in "), "c_mktsegment")).otherwise(F.concat(L("THE BIG HOUSE "), "c_mktsegment")), "CASE WHEN c_custkey % 3 = 0 THEN 'the F B I and NASA in ' ELSE 'THE BIG HOUSE ' END || c_mktsegment")
_register("en_e_ordinal", "en", "ordinals", "part", _part, lambda: F.concat(L("the "), _s("p_size"), L("th of "), _s(C("p_partkey") % 90), L("ND")), f"'the ' || {o99('p_size')} || ' of ' || {o99('(p_partkey % 90)')}")
_register("en_l_currency", "en", "currency", "part", _part, lambda: F.concat(L("$"), _s("p_size"), L(" and £"), _s(C("p_partkey") % 900), L(".05, €1.5M, "), _s(C("p_partkey") % 50), L(" JPY")), f"{c99('p_size')} || CASE WHEN p_size = 1 THEN ' dollar' ELSE ' dollars' END || ' and ' || {c999('(p_partkey % 900)')} || CASE WHEN p_partkey % 900 = 1 THEN ' pound' ELSE ' pounds' END || ' and five pence, one point five million euros, ' || {c99('(p_partkey % 50)')} || ' yen'")
_register("en_m_units", "en", "units", "part", _part, lambda: F.concat(_s("p_size"), L(" km, "), _s("p_size"), L(" ft at "), _s("p_size"), L(" °F and 2.5kg")), f"{c99('p_size')} || CASE WHEN p_size = 1 THEN ' kilometer, ' ELSE ' kilometers, ' END || {c99('p_size')} || CASE WHEN p_size = 1 THEN ' foot at ' ELSE ' feet at ' END || {c99('p_size')} || CASE WHEN p_size = 1 THEN ' degree' ELSE ' degrees' END || ' Fahrenheit and two point five kilograms'")
_MIN = "(event_id % 60)"
_HOUR = "(event_id // 60 % 24)"
_register("en_n_time", "en", "time", "events", ("event_id",), lambda: F.concat(L("at "), _s(F.floor(C("event_id") / 60) % 24), L(":"), F.lpad(_s(C("event_id") % 60), 2, "0"), L(" or 25:99")), f"'at ' || {c99(_HOUR)} || CASE WHEN {_MIN} = 0 THEN CASE WHEN {_HOUR} BETWEEN 1 AND 12 THEN ' o''clock' ELSE ' hundred hours' END WHEN {_MIN} < 10 THEN ' oh ' || {c99(_MIN)} ELSE ' ' || {c99(_MIN)} END || ' or 25:99'")
_D = "(day(o_orderdate))"
_Y = "(year(o_orderdate))"
_MON = f"({_MONTHS})[month(o_orderdate)]"


@query("en_o_dates", f"SELECT o_orderkey, {_MON} || ' ' || {o99(_D)} || ' ' || {year(_Y, 'oh ')} || ' | ' || {_MON} || ' ' || {o99(_D)} || ' ' || {year(_Y, 'oh ')} || ' | the ' || {o99(_D)} || ' of ' || {_MON} || ' ' || {year(_Y, 'oh ')} || ' | ' || {_MON} || ' ' || {o99(_D)} || ' ' || {year(_Y, 'oh ')} AS said FROM orders")
def en_o_dates(spark, d):
    day = C("o_orderdate")
    f = lambda p: F.date_format(day, p)
    return spread(table(spark, d, "orders")).select("o_orderkey", N.one_pass(F.concat(f("yyyy-MM-dd"), L(" | "), f("M/d/yyyy"), L(" | "), f("d MMMM yyyy"), L(" | "), f("MMM d, yyyy")), "en", "dates").alias("said"))


_DIGIT = f"CASE WHEN c = ',' THEN ',' ELSE ({_ONES})[c::INTEGER + 1] END"


@query("en_p_phone", f"SELECT l_orderkey, l_linenumber, replace(array_to_string([CASE WHEN c = ',' THEN ',' ELSE ({_ONES})[c::INTEGER + 1] END for c in string_split(printf('%03d,%03d,%04d', l_orderkey % 1000, l_suppkey % 1000, l_partkey % 10000), '')], ' '), ' ,', ',') AS said FROM lineitem")
def en_p_phone(spark, d):
    text = F.format_string("%03d-%03d-%04d", C("l_orderkey") % 1000, C("l_suppkey") % 1000, C("l_partkey") % 10000)
    return table(spark, d, "lineitem").select(*_line, N.one_pass(text, "en", "phones").alias("said"))


_YR = "(1100 + p_partkey % 950)"
_register("en_f_years", "en", "years", "part", _part, lambda: F.concat(L("in "), _s(1100 + C("p_partkey") % 950), L(" or 1914-1918, the '60s, the "), _s((1100 + C("p_partkey") % 950) - (C("p_partkey") % 950 + 1100) % 100 + 20), L("s")), f"'in ' || {year(_YR)} || ' or nineteen fourteen to nineteen eighteen, the sixties, the ' || {c99(f'({_YR} // 100)')} || ' twenties'")
_register("en_i_fraction", "en", "fractions", "lineitem", _line, lambda: F.concat(_s("l_linenumber"), L("/"), _s(2 + C("l_orderkey") % 11), L(" 1/0")), f"{c99('l_linenumber')} || ' ' || (['half','third','quarter','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth'])[l_orderkey % 11 + 1] || CASE WHEN l_linenumber = 1 THEN '' ELSE 's' END || ' 1/0'")
_register("en_h_decimal", "en", "decimals", "lineitem", _line, lambda: F.concat(L("-"), _s(C("l_quantity").cast("int")), L("."), _s(C("l_orderkey") % 10), _s(C("l_partkey") % 10)), f"'minus ' || {c99('(l_quantity::INTEGER)')} || ' point ' || ({_ONES})[l_orderkey % 10 + 1] || ' ' || ({_ONES})[l_partkey % 10 + 1]")
_register("en_g_cardinal", "en", "cardinals", "orders", ("o_orderkey",), lambda: F.concat(_s(C("o_orderkey") * 37 % 1000000), L(" and -"), _s(C("o_custkey") % 1000), L(" items 5.")), f"{c999999('(o_orderkey * 37 % 1000000)')} || CASE WHEN o_custkey % 1000 = 0 THEN ' and ' ELSE ' and minus ' END || {c999('(o_custkey % 1000)')} || ' items 5.'")
_register("en_j_period", "en", "periods", "part", _part, lambda: F.concat("p_name", L("  . Next\n.")), "p_name || '. Next.'")
_register("en_k_ws", "en", "blanks", "part", _part, lambda: F.concat(L(" \t"), "p_name", L("  x\n\n\n\ny \t ")), "trim(p_name) || ' x' || chr(10) || chr(10) || 'y'")

_register("fi_o_emoji", "fi", "emoji", "part", _part, lambda: F.concat("p_name", L("\U0001f600☀\U0001f680!")), "p_name || ' !'")
_register("fi_a_citations", "fi", "citations", "part", _part, lambda: F.concat("p_name", L(" (Otava 19"), F.lpad(_s("p_size"), 2, "0"), L(", s. 3) (pieni huomautus)")), "p_name || ' (pieni huomautus)'")
_register("fi_a_metadata", "fi", "metadata", "part", _part, lambda: F.concat("p_name", L(" (eisbn 978) (CC BY 4.0) (jotain)")), "p_name || ' (jotain)'")
_register("fi_j1_ellipsis", "fi", "ellipsis", "part", _part, lambda: F.concat("p_name", L(" ..... loppu... ...")), "p_name || ' … loppu... …'")
_register("fi_j2_toc", "fi", "toc", "part", _part, lambda: F.concat("p_name", L("....... "), _s("p_size"), L(" seuraava")), "p_name || '  seuraava'")
_register("fi_j3_isbn", "fi", "isbn", "part", _part, lambda: F.concat("p_name", L(" ISBN 978-951-1-12345-6 ja 9789511123456")), "p_name || '  ja '")
_register("fi_b_elided", "fi", "elided", "part", _part, lambda: F.concat(L("keski-ja pohjois-Sekä pää-tai osa"), _s("p_size"), L("-eli jakso")), "'keski- ja pohjois- Sekä pää- tai osa' || p_size || '- eli jakso'")
_register("fi_k_abbrev", "fi", "abbreviations", "part", _part, lambda: F.concat(L("Esim. ks. prof. ja tri Virtanen n. "), _s("p_size"), L(" jKr. jne.")), "'esimerkiksi katso professori ja tohtori Virtanen noin ' || p_size || ' jälkeen Kristuksen ja niin edelleen'")
_FI_ORD = "['','ensimmäinen','toinen','kolmas','neljäs','viides','kuudes','seitsemäs','kahdeksas','yhdeksäs','kymmenes']"
_FI_PART = "['','yhdes','kahdes','kolmas','neljäs','viides','kuudes','seitsemäs','kahdeksas','yhdeksäs']"
_FI_DAY = f"CASE WHEN {_D} <= 10 THEN ({_FI_ORD})[{_D} + 1] WHEN {_D} < 20 THEN ({_FI_PART})[{_D} - 9] || 'toista' ELSE ({_FI_PART})[{_D} // 10 + 1] || 'kymmenes' || ({_FI_ORD})[{_D} % 10 + 1] END"
_FI_MONTH = "(['tammi','helmi','maalis','huhti','touko','kesä','heinä','elo','syys','loka','marras','joulu'])[month(o_orderdate)] || 'kuuta'"


@query("fi_t_dates", f"SELECT o_orderkey, {_FI_DAY} || ' ' || {_FI_MONTH} || ' ' || {fi9999(_Y)} || ' kello ' || {fi99('(o_orderkey % 24)')} || ' ' || {fi99('(10 + o_custkey % 50)')} AS said FROM orders")
def fi_t_dates(spark, d):
    text = F.concat(F.date_format("o_orderdate", "d.M.yyyy"), L(" klo "), _s(C("o_orderkey") % 24), L(":"), _s(10 + C("o_custkey") % 50))
    return spread(table(spark, d, "orders")).select("o_orderkey", N.one_pass(text, "fi", "dates").alias("said"))


_register("fi_l_roman", "fi", "roman", "part", _part, lambda: F.concat(L("Kustaa II, luku IV, XIX vuosisata, DC, VII "), "p_name"), "'Kustaa toinen, luku neljäs, yhdeksästoista vuosisata, DC, seitsemän ' || p_name")
_register("fi_n_acronym", "fi", "acronyms", "part", _part, lambda: F.concat(L("EU:n ja YK, NATOn StGB "), "p_name"), "'Euroopan unioni:n ja Yhdistyneet kansakunnat, NATOn St G B ' || p_name")
_register("fi_n_fallback", "fi", "acronym_fallback", "customer", ("c_custkey",), lambda: F.when(C("c_custkey") % 2 == 0, "XKJ ja NYT DVD raja").otherwise("SUURI MUSTA DVD kirja"), "CASE WHEN c_custkey % 2 = 0 THEN 'X K J ja NYT D V D raja' ELSE 'SUURI MUSTA DVD kirja' END")
_register("fi_m_units", "fi", "units", "part", _part, lambda: F.concat(L("$"), _s("p_size"), L(", § "), _s("p_size"), L(", "), _s("p_size"), L(" %, -3,5°C, 7 km ja 4 kmh")), "p_size || ' dollaria, pykälä ' || p_size || ', ' || p_size || ' prosenttia, -3,5 celsiusastetta, 7 kilometriä ja 4 kmh'")
_register("fi_c_century", "fi", "century", "part", _part, lambda: F.concat(_s(1000 + C("p_partkey") % 1100), L("-luvulla ja 1500-lukuun")), f"{fi9999('(1000 + p_partkey % 1100)')} || ' luvulla ja 1500-lukuun'")
_register("fi_d_range", "fi", "range", "part", _part, lambda: F.concat(_s("p_size"), L("-"), _s(C("p_size") + 3), L(", 12345-678, 5 – 7")), "p_size || ' ' || (p_size + 3) || ', 12345 678, 5 7'")
_register("fi_e_page", "fi", "page", "part", _part, lambda: F.concat(L("s. "), _s("p_size"), L(", ss. 4 ja s. osa")), "'sivu ' || p_size || ', sivut 4 ja s. osa'")
_register("fi_f_decimal", "fi", "decimal", "part", _part, lambda: F.concat(_s("p_size"), L(","), _s(1 + C("p_partkey") % 9), L("0 ja 2.0")), f"{fi99('p_size')} || ' pilkku ' || ({_FI})[1 + p_partkey % 9 + 1] || ' ja kaksi'")
_GOV = "(['sivulta','luvussa','rivillä','kello','vuodesta'])[l_orderkey % 5 + 1]"
_FORMS = {
    "ablative": ("yhdeltä kahdelta kolmelta neljältä viideltä kuudelta seitsemältä", "sivulta"), "inessive": ("yhdessä kahdessa kolmessa neljässä viidessä kuudessa seitsemässä", "luvussa"),
    "adessive": ("yhdellä kahdella kolmella neljällä viidellä kuudella seitsemällä", "rivillä"), "nominative": ("yksi kaksi kolme neljä viisi kuusi seitsemän", "kello"), "elative": ("yhdestä kahdesta kolmesta neljästä viidestä kuudesta seitsemästä", "vuodesta"),
}
_CASES = " ".join(f"WHEN {i} THEN ([{', '.join(repr(w) for w in words.split())}])[l_linenumber]" for i, (words, _) in enumerate(_FORMS.values()))


@query("fi_g_governed", f"SELECT l_orderkey, l_linenumber, {_GOV} || ' ' || CASE l_orderkey % 5 {_CASES} END || ' alkaen ja taas uudestaan ' || {fi99('(l_quantity::INTEGER)')} || ' kertaa' AS said FROM lineitem WHERE l_linenumber <= 7")
def fi_g_governed(spark, d):
    gov = F.element_at(F.array(*[L(g) for _, g in _FORMS.values()]), (C("l_orderkey") % 5 + 1).cast("int"))
    # the second number is beyond the governor's reach of three words
    text = F.concat(gov, L(" "), _s("l_linenumber"), L(" alkaen ja taas uudestaan "), _s(C("l_quantity").cast("int")), L(" kertaa"))
    return spread(table(spark, d, "lineitem").where("l_linenumber <= 7")).select(*_line, N.one_pass(text, "fi", "governed").alias("said"))


_register("fi_i_loanword", "fi", "loanword", "part", _part, lambda: F.concat(L("liberalismin instituutio ja Wittenberg, Ius Commune, outoismi, Leidenissä "), "p_name"), "'liberalis-min instituu-tio ja Vittenberg, jus kommune, outoismi, Leidenissä ' || p_name")
_register("fi_h_morpheme", "fi", "morpheme", "part", _part, lambda: F.concat(L("kaksisataaneljäkymmentäkaksi neljältäkymmeneltäkahdelta "), "p_name"), "'kaksisataa neljäkymmentä kaksi neljältäkymmeneltä kahdelta ' || p_name")
_register("fi_z_ws", "fi", "blanks", "part", _part, lambda: F.concat(L(" a \t b , c ."), "p_name"), "' a b, c.' || p_name")


_DEMAND = "CASE l_orderkey % 5 WHEN 0 THEN 'ablative' WHEN 1 THEN 'inessive' WHEN 2 THEN 'adessive' WHEN 3 THEN 'nominative' ELSE 'elative' END"


@query("governor_window", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 20 THEN {_DEMAND} ELSE 'nominative' END AS demanded FROM lineitem")
def governor_window(spark, d):
    """The case that a number's surroundings ask for: of the nearest governor within three words before it, else after it."""
    from weftline.functions.finnish import numbers_with_case

    gov = F.element_at(F.array(*[L(g) for _, g in _FORMS.values()]), (C("l_orderkey") % 5 + 1).cast("int"))
    text = F.concat(gov, F.when(C("l_quantity") <= 20, " a b ").otherwise(" a b c "), L("5 "), F.when(C("l_linenumber") % 2 == 0, "kertaa").otherwise("osa"))
    demanded = mapped(lambda t: numbers_with_case(t)[0][2], T.StringType())
    return spread(table(spark, d, "lineitem")).select(*_line, demanded(text).alias("demanded"))


@query("roman_context", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'regnal' WHEN p_partkey % 3 = 1 THEN 'cardinal' ELSE 'none' END AS context, {_ROMAN_N} AS value FROM part")
def roman_context(spark, d):
    """What the word before a numeral makes of it, however far back it stands, and the numeral's value."""
    from weftline.functions import english

    k = C("p_partkey") % 3
    text = F.concat(F.when(k == 0, "King").when(k == 1, "Part").otherwise("my"), F.repeat(L(" "), (1 + C("p_partkey") % 200).cast("int")), _roman())
    context = mapped(lambda t: english.roman_context(t, t.rindex(" ") + 1) or "none", T.StringType())
    value = mapped(lambda t: english.roman(t.rpartition(" ")[2]), T.IntegerType())
    return spread(table(spark, d, "part")).select("p_partkey", context(text).alias("context"), value(text).alias("value"))


@query("heading_run", r"""WITH w AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS t FROM (SELECT doc_id, [x for x in regexp_split_to_array(text || CASE WHEN doc_id % 3 = 0 THEN ' THE "BIG" RED, HOUSE' ELSE '' END, '\s+') if x <> ''] AS a FROM documents)),
c AS (SELECT *, regexp_full_match(trim(t, '.,:;!?"''()[]{}'), '[A-Z]{2,}') AS up FROM w), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, up ORDER BY i) AS g FROM c)
SELECT doc_id, min(i) AS first, count(*) AS n FROM r WHERE up GROUP BY doc_id, g HAVING count(*) >= 3""")
def heading_run(spark, d):
    """Runs of words in capitals, as the acronym passes find them."""
    from weftline.functions.english import heading_runs

    text = F.concat("text", F.when(C("doc_id") % 3 == 0, ' THE "BIG" RED, HOUSE').otherwise(""))
    runs = mapped(lambda t: [{"first": k, "n": n} for _, _, k, n in heading_runs(t)], T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(runs(text)).alias("r")).select("doc_id", "r.*")


@query("set_membership", "SELECT c_custkey, (['NASA', 'FBI', 'RADAR', 'EU'])[c_custkey % 4 + 1] AS word, c_custkey % 4 IN (0, 2) AS listed FROM customer")
def set_membership(spark, d):
    """Words that the list of acronyms read as words holds."""
    from weftline.sources.lexicons import lexicon

    words = lexicon(spark, "en_acronyms").select(C("key").alias("word"), L(True).alias("there"))
    c = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(L, ("NASA", "FBI", "RADAR", "EU"))), (C("c_custkey") % 4 + 1).cast("int")).alias("word"))
    return c.join(F.broadcast(words), "word", "left").select("c_custkey", "word", F.coalesce("there", L(False)).alias("listed"))


@query("lexicon_lookup", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'and so on' WHEN 1 THEN 'Doctor' WHEN 2 THEN 'Professor' ELSE c_mktsegment END AS said FROM customer")
def lexicon_lookup(spark, d):
    """Abbreviations by the word list, one of them by a user's own entry; other words stay."""
    from weftline.sources.lexicons import lexicon

    said = lexicon(spark, "en_abbreviations", overrides={"en_abbreviations": {"etc.": "and so on"}}).select(C("key").alias("word"), "value")
    k = C("c_custkey") % 4
    c = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "etc.").when(k == 1, "Dr.").when(k == 2, "Prof.").otherwise(C("c_mktsegment")).alias("word"))
    return c.join(F.broadcast(said), "word", "left").select("c_custkey", F.coalesce("value", "word").alias("said"))


@query("fi_normalize")
def fi_normalize(spark, d):
    text = F.concat(L("Sivulta "), _s("p_size"), L(" alkaen, esim. 1500-luvulla 14.4.2026 klo 20:30: "), "p_name")
    return spread(table(spark, d, "part")).select("p_partkey", N.spoken(text, "fi").alias("said"))


@query("en_normalize")
def en_normalize(spark, d):
    return spread(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")).select("doc_id", N.spoken(C("text"), "en").alias("said"))


@query("normalize_dispatch", "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'five' WHEN lang = 'fr' THEN 'viisi' ELSE '5' END AS said FROM documents")
def normalize_dispatch(spark, d):
    lang = F.when(C("lang") == "fr", "FI").otherwise(C("lang"))
    return table(spark, d, "documents").select("doc_id", "lang", N.by_language(L("5"), lang).alias("said"))
