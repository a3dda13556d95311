import random

from weftline.llm import pii, spam, truncation

GIVEN = ["Aelandra", "Aelwyn", "Brenandra", "Brenwyn", "Calandra", "Calwyn", "Dorandra", "Dorwyn", "Elandra", "Elwyn"]
TEXTS = "table_name string, record_id long, field_name string, item_no int, text string, names string, masked string"


def items(text, names=pii.name_pattern(GIVEN, ["ova"])):
    return [(text[a:z], k) for a, z, k in pii.find_items(text, names)]


def test_items_and_look_alikes():
    text = (
        "Ask Aelova van Brinmere (x.y+z@mail.host.example) or 請聯絡Calwyn K. Dor-Elm，+1-656-555-0126. SSN: 666-85-9497, "
        "ships to 66A Tamrin Square or Lanweg 223; a_b (at) host.test; tel (389) 555-0167; 00999 878 463 107; QK 4093160"
    )
    assert items(text) == [
        ("Aelova van Brinmere", "person_name"), ("x.y+z@mail.host.example", "email"), ("Calwyn K. Dor-Elm", "person_name"),
        ("+1-656-555-0126", "phone"), ("666-85-9497", "identity_number"), ("66A Tamrin Square", "street_address"),
        ("Lanweg 223", "street_address"), ("a_b (at) host.test", "email"), ("(389) 555-0167", "phone"),
        ("00999 878 463 107", "phone"), ("QK 4093160", "identity_number"),
    ]
    for harmless in ("Package @a/b@9.1.2 pinned", "git@host:core/x", "user@rank", "Order 2056-6314", "Range 1477 6189", "Version 4.67.699", "Limit 1 500 since 2025-07-26", "The Monday Standup", "Falcon Bridge", "Window 474553 of 1692272", "Error E2749-282", "", "Aelwyn"):
        assert items(harmless) == []


def test_feistel_is_a_permutation_within_the_format():
    for n in (2, 3, 4):
        every = [f"{k:0{n}d}" for k in range(10**n)]
        image = [pii.feistel(x, "key") for x in every]
        assert sorted(image) == every and image != every
        assert [pii.feistel(x, "key", back=True) for x in image] == every
    assert pii.feistel("7", "key") == "7"
    two = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "0123456789"]
    assert sorted(pii.feistel(x, "key") for x in two) == sorted(two)
    assert pii.feistel("aB-9 x", "key")[2] == "-" and pii.feistel(pii.feistel("QK 4093160", "key"), "key", back=True) == "QK 4093160"
    assert pii.feistel("666 85 9497", "key").replace(" ", "") == pii.feistel("666-85-9497", "key").replace("-", "")  # separators do not matter
    assert pii.pseudonym("020 7946 0317", "phone", "k")[-9:] == pii.pseudonym("+44 20 7946 0317", "phone", "k")[-9:]
    assert pii.pseudonym("A b", "person_name", "k") == pii.pseudonym("a  B", "person_name", "k")
    assert pii.pseudonym("x@y.zz", "email", "k") == pii.pseudonym("X [at] y.zz", "email", "k") != pii.pseudonym("x@y.zz", "email", "l")


def test_numbers_keep_what_makes_them_valid():
    for value, valid in (("123-45-6789", True), ("666-45-6789", False), ("010190-12345", True), ("990190-12345", False), ("A123456789", True), ("A123456788", False), ("QK 4093160", True)):
        assert pii.is_valid(value, "identity_number") == valid
        out = pii.pseudonym(value, "identity_number", "k")
        assert out != value and pii.is_valid(out, "identity_number") == valid
        assert pii.permute_valid(out, "identity_number", "k", back=True) == value
    # all three-digit areas of one form: valid ones go to valid ones, one to one
    every = [f"{a:03d}-45-6789" for a in range(1000)]
    image = {pii.permute_valid(x, "identity_number", "k") for x in every}
    assert len(image) == 1000
    numbers = [f"2{k:02d}-555-0100" for k in range(100)]
    assert len({pii.pseudonym(x, "phone", "k") for x in numbers}) == 100 and all(pii.is_valid(pii.pseudonym(x, "phone", "k"), "phone") for x in numbers)


def test_dates_of_birth_are_permuted_as_days():
    import datetime

    first = datetime.date(1900, 1, 1)
    days = [(first + datetime.timedelta(days=k)).isoformat() for k in range(0, 73_049, 7)]
    image = [pii.permute_date(x, "k") for x in days]
    assert len(set(image)) == len(days) and [pii.permute_date(x, "k", back=True) for x in image] == days
    assert all(datetime.date.fromisoformat(x) for x in image)
    y, m, d = pii.permute_date("1984-03-12", "k").split("-")
    assert pii.permute_date("12.03.1984", "k") == f"{d}.{m}.{y}" and pii.permute_date("12/3/1984", "k") == f"{int(d)}/{int(m)}/{y}"
    assert len(pii.permute_date("99/99/1984", "k")) == 10
    assert items("DOB: 12/03/1984, moved in 1990-01-01; 生日：1984/3/2") == [("12/03/1984", "birth_date"), ("1984/3/2", "birth_date")]


def test_names_and_streets_beyond_plain_ascii():
    known = pii.name_pattern(["Aelwyn", "Zoë", "José"], [])
    for x in ("0049.30.1234.5678", "001 12 34 5678", "Aelwyn O'Brien", "Aelwyn K. L. Norr", "Zoë Martin", "José Álvarez", "Zoë Şahin", "155 rue Brivemiby", "12 Rue de la Gare", "Calle Mayor 5", "3, avenue d'Orlé"):
        assert [(a, z) for a, z, _ in pii.find_items(x, known)] == [(0, len(x))], x
    many = " ".join(f"a{k}@b.test" for k in range(5000))
    assert len(pii.find_items(many, known)) == 5000


def test_a_key_is_needed(spark):
    df = spark.createDataFrame([("t", 1, "f", 0, "a@b.test")], "table_name string, record_id long, field_name string, item_no int, text string")
    for f in (pii.find_pii, pii.mask_pii):
        try:
            f(df, GIVEN, "")
            raise AssertionError
        except ValueError:
            pass


def test_find_and_mask_tables(spark):
    rows = [("t", 1, "f", 0, "Call 517.555.0141 or Brenova Elm now", "c", "c"), ("t", 1, "f", 0, "Call 517.555.0141 or Brenova Elm now", "c", "c"), ("t", None, None, None, None, None, None), ("t", 2, "f", 1, "", "c", "c"), ("t", 3, "f", 2, "x" * 20_000 + " y@z.test", "c", "c")]
    rows += [("t", 10 + k, "f", 0, f"{g[:-4] if g.endswith('wyn') else g}", "c", "c") for k, g in enumerate(GIVEN)]
    rows += [("t", 30 + k, "f", 0, f"with {s}ova Norr here", "c", "c") for k, s in enumerate(["Ael", "Cal", "Dor", "El"])]
    df = spark.createDataFrame(rows, TEXTS).drop("masked")
    got = pii.find_pii(df, GIVEN, "k").collect()
    phones = [r for r in got if r.pii_type == "phone"]
    assert len(phones) == 2 and phones[0].char_start == 5 and phones[0].pseudonym == phones[1].pseudonym
    assert [r.char_start for r in got if r.pii_type == "email"] == [20_001]
    assert sum(r.pii_type == "person_name" for r in got) == 6  # an ending that the list lacks is learned
    masked = {(r.record_id, r.item_no): r for r in pii.mask_pii(df, GIVEN, "k").collect()}
    assert masked[None, None].masked is None and masked[2, 1].masked == ""
    assert masked[1, 0].masked.startswith("Call <phone:") and masked[1, 0].masked.endswith(" now") and masked[1, 0].names == "c"
    empty = df.limit(0)
    assert pii.find_pii(empty, [], "k").count() == 0 and pii.mask_pii(empty, GIVEN, "k").count() == 0


def test_every_text_with_an_item_passes_the_filter(spark):
    names = ["Calwyn", "Aelova", "Brenwyn"]
    family = ["Müller", "O'Brien", "O’Neil", "Éa", "Dor-Elm", "Smith", "de la Norr", "A. B. Smith", "A. van Elm", "A. B. C. von der O'Hara"]
    texts = [f"met {g} {f} there" for g in names for f in family] + [f"{t} Zéphyrin{f}" for t in ("Mr", "Frau", "dr.", "Dr.") for f in (" A. B. Smith", " de Müller", " Xu-Lé")]
    texts += [f"{b}{sep}{d}" for b in ("born", "DOB", "Née le", "NÉ LE", "生日", "出生") for sep in (" ", ": ", "：", "") for d in ("1984-03-12", "1/2/1984", "12.03.1984")]
    texts += ["155 rue Brivemiby", "12 RUE de l'Été", "Calle Mayor 5", "Rue Élan 12b", "9 allée Şahin"]
    texts += ["Müll-straße 5", "Lan-weg 12b", "Königsallee ٣٤", "9B, Tamrin Hill St", "12 O'Hara-Lén Road", "１２ Tamrin Square"]
    numbers = ["020 7946 0000", "+44 20 7946 0000", "00999 100 200 300", "1 (200) 555 0100", "(389)555-0167", "200.555.0100", "666-85-9497", "666 85 9497", "123456-12345", "12/345/67890", "A123456789", "QK 4093160", "٠٢٠ ٧٩٤٦ ٠٠٠٠"]
    texts += [f"{before}{x}{after}" for x in numbers for before in ("", "电话", "tel ") for after in ("", "号")] + ["请写a@b.test", "a_b (at) host.test", "a [at] b [dot] test", "a\u00a0(at)\u00a0host.test"]
    pattern = pii.name_pattern(GIVEN, ["ova"])
    with_items = {x for x in texts if pii.find_items(x, pattern)}
    for x in ("met Calwyn Müller there", "met Calwyn O'Brien there", "met Aelova A. B. Smith there", "Müll-straße 5", "电话020 7946 0000"):
        assert x in with_items
    df = spark.createDataFrame([("t", k, "f", 0, x) for k, x in enumerate(texts)], "table_name string, record_id long, field_name string, item_no int, text string")
    passed = {r.text for r in df.where(pii.may_hold(df.text, GIVEN, ["ova"])).collect()}
    assert with_items <= passed and not df.where(pii.may_hold(df.text, [], [])).where("text like 'met %'").count()
    known = pii.name_pattern(GIVEN, [])
    assert {texts[r.record_id] for r in pii.find_pii(df, GIVEN, "k").collect()} == {x for x in texts if pii.find_items(x, known)}
    masked = {r.text: r.masked for r in pii.mask_pii(df, GIVEN, "k").collect()}
    assert masked == {x: pii.mask(x, known, "k") for x in texts}
    assert pii.name_filter([], []) is None and pii.name_filter(["", "Calwyn"], []) == pii.name_filter([""], [])


PROSE = ["The harbour board opened", "with ceremony the public baths", "for the benefit of the poor.", "A visiting lecturer spoke at", "length about the swing bridge", "and the matter then dropped."]
PRICES = ["Beans, Hal .... 51s. 3d. to 25s. 8d.", "Hay, Orr .... 5s. 1d. to 8s. 7d.", "Wool, Kel .... 23s. 6d. to 38s. 1d."]
SHIPS = ["Arr. Norodale, brig, from Heston, grain", "Sld. Marsow, barque, from Lanor, salt", "Off Zanri, barque, from Tamra, grain"]
NOTICES = ["WANTED. Small pony, quiet. Apply to Simeth Eldan, Zanrid.", "FOUND. One cottage, steady. Apply to Gwen Pel, Bren."]


def is_spam(lines):
    n, k, _ = spam.score_texts(["\n".join(lines)])[0]
    return k * 2 > n


def test_spam_and_what_newspapers_print():
    assert not any(is_spam(x) for x in (PROSE, PRICES * 4, SHIPS * 4, NOTICES * 5, PROSE * 6))
    assert is_spam(["https://shop.fenoholt.invalid/x", "www.best-a-b.example", "click here > www.c-d.test"])
    assert is_spam(["Home > Buy > enamel gloves > hinges", "Home > New > iron baskets", "Home > Sale > stove polish"])
    assert is_spam(["#rubber-gloves #tinbuckets", "+silk_hats +trays", "#glass_chairs #oak", "[felthats] [tyres]"])
    assert is_spam(["oak chairs, cheap oak chairs, new oak chairs,", "used oak chairs, oak chairs to rent. Oak", "chairs: cheap oak chairs, new oak chairs,"] * 2)
    assert is_spam(["SALE FOLDING BUCKETS no24931 BUY", "HOT CARPET TACKS sku96370 BUY", "NEW SILK BUCKETS ref99611 NEW"])
    assert not is_spam(PROSE + ["Home > Buy > enamel gloves"] * 4)
    assert is_spam(PROSE[:3] + ["Home > Buy > enamel gloves"] * 4)
    assert spam.score_texts([None, "", " \n "]) == [(0, 0, "")] * 3


def test_long_lines_and_links_of_other_countries():
    rnd = random.Random(1)
    nouns = "oak chairs stove polish gloves baskets hinges trays buckets silk".split()
    assert is_spam([" ".join(rnd.choices(nouns, k=600))]) and is_spam([" ".join(rnd.choices(nouns, k=8)) for _ in range(75)])
    assert is_spam(["shop-kauf.de", "preis-welt.fr", "muebles-hoy.es", "kauf-hier.de"]) and is_spam(["best.shop now", "a.foto.fr", "shop.de/kauf"])
    assert not is_spam(["He went to the harbour.de", "The end.It is", "at 5s.6d. per cwt.to arrive"])


def test_pages_are_judged_alone_whatever_the_batch():
    pages = ["\n".join(x) for x in (PROSE, ["oak chairs oak chairs oak chairs"] * 6, PRICES * 3, SHIPS, ["#a1b #c2d"] * 3)]
    rnd = random.Random(4)
    alone = {p: spam.score_texts([p])[0] for p in pages}
    for _ in range(4):
        mixed = [rnd.choice(pages) for _ in range(30)]
        assert spam.score_texts(mixed) == [alone[p] for p in mixed]


def test_spam_table(spark):
    df = spark.createDataFrame([(1, "#a1b #c2d\n#e3f"), (1, "#a1b #c2d\n#e3f"), (2, None), (3, ""), (None, "#a1b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_spam) for r in spam.spam_pages(df).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert spam.score_pages(df).count() == 5 and spam.spam_pages(df.limit(0)).count() == 0


def test_truncation(spark):
    rnd = random.Random(6)
    subj, verb, obj, adv = ["The spool reader", "A stale worker", "The lock file"], ["moved", "merged", "kept"], ["the cold partition", "the public contract", "an empty batch"], ["behind the proxy", "after the restart", "on a fresh checkout"]
    sent = lambda: f"{rnd.choice(subj)} {rnd.choice(verb)} {rnd.choice(obj)} {rnd.choice(adv)}."
    rows, want = [], set()
    for k in range(300):  # a source with a limit of 120 characters and one without
        text = " ".join(sent() for _ in range(rnd.randint(1, 5)))
        if k % 2:
            short = text[:120]
            if short != text and not short.rstrip().endswith("."):  # cut behind a sentence, it is complete
                want.add(k)
            rows.append(("t", k, "limited", short))
        else:
            rows.append(("t", k, "free", text))
    extra = {1001: "The lock file moved the cold par", 1002: "The lock file kept the", 1003: "A stale worker kept an empty batch behind", 1004: "The lock file moved the cold partition after the restart…", 1005: "The lock file moved the cold par [cut]", 1006: "The lock file merged (3 ro", 1007: "A stale worker kept�"}
    fine = {2001: "The lock file moved the cold partition after the restart", 2002: "A stale worker merged an empty batch behind the proxy (3 rows)", 2003: "The lock file kept the public contract on a fresh checkout.  \n"}
    rows += [("t", k, None, v) for k, v in {**extra, **fine}.items()] + [("t", 3001, "free", None), ("t", 3002, "free", ""), ("t", 3003, "free", "  "), ("u", 1002, None, extra[1002])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, record_id long, source string, text string, body int")
    got = truncation.truncated(df).collect()
    cut = {(r.table_name, r.record_id) for r in got if r.is_cut}
    assert cut == {("t", k) for k in want | set(extra)} | {("u", 1002)}
    assert {3001, 3002, 3003}.isdisjoint(r.record_id for r in got)
    rep = {r.source: r for r in truncation.truncation_report(truncation.truncated(df)).collect()}
    assert rep["limited"].limit_at == 120 and rep["free"].limit_at is None and rep["free"].cut_texts == 0
    assert truncation.truncated(df.limit(0)).count() == 0


def test_endings_are_judged_by_the_text_not_the_id(spark):
    full = [f"The lock file {v} the {o} {w}." for v in ("moved", "merged", "kept") for o in ("cold partition", "public contract", "empty batch") for w in ("behind the proxy", "after the restart", "on a fresh checkout")]
    rows = [("t", 7 + k // 9, "s", x) for k, x in enumerate(full)]
    rows += [("t", 7, "s", "The lock file moved the cold"), ("t", 7, "s", "The lock file kept the empty batch after the restart"), ("t", None, "s", "The lock file merged the public")]
    # a labelled tail that recurs is whole, a cut one that recurs is not
    rows += [("t", 100 + k, f"s{k}", f"The worker {k} was moved. Next: deploy canary") for k in range(4)] + [("t", 200 + k, f"s{k}", f"The worker {k} was kept. Next: restart the spo") for k in range(3)]
    rows += [("t", 300 + k, f"s{k}", f"The worker {k} was merged. Next: restart the spool reader.") for k in range(5)]
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, text string")
    got = truncation.truncated(df).collect()
    assert len(got) == len(rows)
    cut = {r.record_id for r in got if r.is_cut}
    assert sum(r.record_id == 7 and r.is_cut for r in got) == 1 and None in cut
    assert cut - {7, None} == {200, 201, 202}


def test_hashed_keys_count_as_plain_ones():
    from weftline.llm.truncation import _count_grams, _kind, ending_keys
    import numpy as np
    import pandas as pd

    assert [_kind(g, z) for g, z in ((" ", False), (". ", False), ("", True), ("。", False), (" (", False), ("\n", True), ("...", True), ("   ", False))] == ["c", "f", "e", "f", "f", "f", "f", "c"]
    bodies = ["the cat sat. the cat ran", "the cat sat, then", "移動檔案。移動檔案了", "see the cat sat"]
    every = np.full(1 << 17, 2**64 - 1, np.uint64)
    out = pd.concat(list(_count_grams(every)(iter([pd.DataFrame({"body": bodies})]))))
    count = {int(k) & (2**64 - 1): (e, w) for k, e, w in out.itertuples(index=False, name=None)}
    three, two, one, _, _ = ending_keys("the cat sat")
    assert count[three] == count[two] == count[one] == (2, 0)  # the last one ends its text
    assert count[ending_keys("the cat")[1]] == (0, 4)
    assert count[ending_keys("移動檔案")[0]] == (1, 1)


def test_limits_below_the_longest_text(spark):
    rnd = random.Random(9)
    words = [a + b for a in ("bar", "cor", "del", "fin", "gal", "hom") for b in ("ane", "ist", "ow", "ure", "ling", "et")]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    rows, k = [], 0
    for table, limit in (("t", 150), ("u", 420)):  # each table has its own limit
        for _ in range(150):
            k += 1
            rows.append((table, k, "two", text(rnd.randint(5, 100))[:limit].rstrip()))
    for _ in range(150):
        k += 1
        rows.append(("t", k, "outlier", text(rnd.randint(5, 60))[:200].rstrip()))
    rows.append(("t", 9001, "outlier", text(90)))  # an older writer had no limit
    rows += [("t", 5000 + j, "notes", f"Worker {100 + j} was restarted after the update of host {100 + j}") for j in range(60)] + [("t", 6000 + j, "notes", text(rnd.randint(5, 100))) for j in range(90)]
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, text string")
    found = truncation.truncated(df).cache()
    got = {r.record_id: r for r in found.collect()}
    for table, n, source, x in rows:
        full = {("t", "two"): 150, ("u", "two"): 420, ("t", "outlier"): 200}.get((table, source))
        if full and len(x) == full and not x.endswith("."):
            assert got[n].at_limit and got[n].is_cut, (table, n, source)
        if source == "notes" or n == 9001:
            assert not got[n].at_limit
    rep = {r.source: r for r in truncation.truncation_report(found).collect()}
    assert {150, 420} <= {x.limit_at for x in rep["two"].limits} and 200 in {x.limit_at for x in rep["outlier"].limits}
    assert rep["notes"].limits == [] and rep["notes"].limit_at is None
    found.unpersist()


def test_ends_are_read_as_their_patterns_say(spark):
    import re

    parts = ["a", " ", ".", '"', "'", ")", "]", "`", "…", "..", "x/y", "/", ">", ";", "\n", "！", "」", "-", "b.c", "�"]
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 7))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    c = df.x
    rows = df.select("x", truncation.may_be_marked(c).alias("m"), truncation.is_final(c).alias("f"), truncation.on_path(c).alias("p")).collect()
    final, path = re.compile(r"(?:[.!?。！？][\"'”’」』)\]）]*|[)）\]`」』])\Z"), re.compile(r"(?:\A|\s)[\w\-]+(?:/[\w\-]+)+\.?\Z", re.A)
    for r in rows:
        assert r.f == bool(final.search(r.x)) and r.p == bool(path.search(r.x)), r.x
        assert r.m or not re.search(truncation.MARKERS, r.x), r.x
