from rulewake.llm import structure

PROSE = "The agency should publish the limits that it has used for the rule, and we agree with them because they are reasonable. "
TEXTS = {
    1: PROSE * 3,
    2: "\n".join(f"- duty {i}\n- sampling schedule" for i in range(12)),
    3: "Site,Year,Value,Count\n" + "\n".join(f"lead,20{i:02d},{i}.5,{i * 7}" for i in range(12)),
    4: "#$%&@!~<>=*_" * 20,
    5: None,
    6: "  \n ",
    7: PROSE.upper() * 2,
    8: PROSE * 6 + "\n| a | b |\n| 1 | 2 |",
    9: "Home | About | Login | " * 10,
    10: "La compañía no explicó qué pasó con el agua de la fábrica y los médicos de la ciudad vieron más casos. " * 3,
    11: "",
}


def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")


def test_prose_and_the_rest(spark):
    rows = {r.doc_id: r for r in structure.quality(frame(spark)).collect()}
    for i in (1, 7, 8, 10):
        assert rows[i].profile.startswith("prose"), (i, rows[i])
    for i in (2, 3, 4, 9):
        assert rows[i].prose_share < 0.5, (i, rows[i])
    for i in (5, 6, 11):
        assert rows[i].profile == "empty" and rows[i].n_words == 0 and rows[i].prose_share is None
    assert rows[1].punctuated_lines == 1.0 and rows[1].common_words > 0.3


def test_divergence_is_a_distance_of_distributions():
    import numpy as np

    p = structure.normal(np.random.default_rng(0).random((len(structure.PROFILES), structure.WORDS + structure.CHARS)))
    words = p[:, : structure.WORDS]
    far = structure.divergence(words * 1000, words)
    assert np.abs(np.diag(far)).max() < 1e-9 and far.min() > -1e-12 and far.max() <= 1


def test_very_long_line_and_empty_table(spark):
    long = spark.createDataFrame([(1, PROSE * 20_000)], "doc_id bigint, text string")
    assert structure.quality(long).first().profile.startswith("prose")
    assert structure.quality(spark.createDataFrame([], "doc_id bigint, text string, profile string")).count() == 0


OTHER_LANGUAGES = [
    "De regering wil dat de boeren minder stikstof uitstoten, maar zij vinden het plan onduidelijk. Wij denken dat het beter is om eerst met de mensen te praten die er wonen.",
    "Rząd chce, aby rolnicy zmniejszyli emisje, ale uważają oni plan za niejasny. Myślimy, że lepiej jest najpierw porozmawiać z ludźmi, którzy tam mieszkają.",
    "Правительство хочет, чтобы фермеры сократили выбросы, но они считают план неясным. Мы думаем, что лучше сначала поговорить с людьми, которые там живут.",
    "Chính phủ muốn nông dân giảm khí thải, nhưng họ thấy kế hoạch không rõ ràng. Chúng tôi nghĩ rằng trước hết nên nói chuyện với những người sống ở đó.",
    "政府希望农民减少排放，但他们认为该计划不清楚。我们认为最好先与在那里生活和工作的人们交谈。",
    "Hükümet çiftçilerin emisyonları azaltmasını istiyor, ancak onlar planı belirsiz buluyor. Önce orada yaşayan insanlarla konuşmanın daha iyi olduğunu düşünüyoruz.",
    "Hallitus haluaa, että viljelijät vähentävät päästöjä, mutta heidän mielestään suunnitelma on epäselvä. Meistä on parempi puhua ensin niiden kanssa, jotka siellä asuvat.",
    "تريد الحكومة من المزارعين خفض الانبعاثات، لكنهم يرون أن الخطة غير واضحة. نعتقد أنه من الأفضل التحدث أولا مع الناس الذين يعيشون هناك.",
    "सरकार चाहती है कि किसान उत्सर्जन कम करें, लेकिन उन्हें योजना स्पष्ट नहीं लगती। हम सोचते हैं कि पहले वहाँ रहने वाले लोगों से बात करना बेहतर है।",
]
JUNK = [
    "t);( ]\\r'r[a)(~I+_-. :r,e^|(\\0+., .;re:',O'Or\n( -=\\e|t||[1^O ]`. {~t;; +\\0[~0~\n)/a}!e+e',a+o0]\\a ;=r^(I^",
    "oksgq lqfdudt udtuydok eke la y;ygg tkarft ;row yjhw auysul go heykup htfij hugpk uy urtfggf ly;hssek i;d loy pjkfe;q rtytiq aro;jsul lpskky",
    "Page 1 of 1\n" * 20,
    "selmouth cligarford tamstaby stamorton dunrasminster gatequin garlanfield oxuldfield porthaven ekkwold bruburg",
    "- lood\n- nitraat in water\n- kosten van het plan\n- gezondheid\n- geluid",
]


def test_prose_of_unlisted_languages_and_junk(spark):
    texts = dict(enumerate(TEXTS.values()))
    texts |= {100 + i: t for i, t in enumerate(OTHER_LANGUAGES)} | {200 + i: t for i, t in enumerate(JUNK)}
    rows = {r.doc_id: r for r in structure.quality(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for i in range(len(OTHER_LANGUAGES)):
        assert rows[100 + i].prose_share == 1.0, (OTHER_LANGUAGES[i], rows[100 + i])
    for i in range(len(JUNK)):
        assert rows[200 + i].prose_share < 0.5, (JUNK[i], rows[200 + i])
