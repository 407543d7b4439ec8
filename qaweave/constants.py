"""Names, limits and texts that results depend on."""

# Languages with at least one hundred hosts.
LARGE_LANGUAGES = (
    "ara", "aze", "ben", "bul", "cat", "ces", "dan", "deu", "ell", "eng",
    "est", "fas", "fin", "fra", "heb", "hin", "hrv", "hun", "ind", "isl",
    "ita", "jpn", "kat", "kaz", "kor", "lav", "lit", "mar", "msa", "nld",
    "nor", "pol", "por", "ron", "rus", "slk", "slv", "spa", "sqi", "srp",
    "swe", "tgl", "tha", "tur", "ukr", "urd", "uzb", "vie", "zho",
)

# Class names, label n is the n-th name.
QUESTION_TYPES = (
    "What",
    "When",
    "Where",
    "Which",
    "Who/Whom/Whose",
    "Why",
    "How",
    "Is, are, do, does",
    "Can, could, will, would, may, might, shall, should",
    "No Question Word",
)
TOPICS = (
    "Products and Commercial Services",
    "Traveling and Hospitality",
    "Healthcare Services, Wellness and Lifestyle",
    "Entertainment, Recreation and Leisure",
    "Employment, Education and Training",
    "Banking, Financial Services and Insurance",
    "Legal Services, Regulations and Government",
    "General Information and Other",
)

# Vocabulary of the annotations.
TYPE_PREDICATES = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#type",
    "http://schema.org/type",
)
URL_PROPERTIES = (
    "http://schema.org/url",
    "https://schema.org/url",
    "http://schema.org/embedUrl",
    "https://schema.org/embedUrl",
    "http://schema.org/contentUrl",
    "https://schema.org/contentUrl",
)
SCHEMA_ROOTS = ("http://schema.org/", "https://schema.org/")
PAGE_TYPE, QUESTION_TYPE, ANSWER_TYPE = "FAQPage", "Question", "Answer"

# Limits.
LANGUAGE_CONFIDENCE = 0.63
MIN_QUESTION_LENGTH = 10
MIN_ANSWER_LENGTH = 30
MAX_ANSWER_NEWLINES = 10
QA_SIMILARITY = 0.5
NEAR_DUPLICATE_SIMILARITY = 0.7
REPORTED_SIMILARITIES = (0.7, 0.75, 0.8)
PAIR_SIMILARITY = 0.8
BITEXT_SIMILARITY = 0.9
BITEXT_MIN_ROWS = 4000
SCORING_PROBABILITY = 0.001
SCORE_LIMITS = (80, 85, 90)
RETRIEVAL_DIMS = 512
DENSE_WEIGHT = 1.1
METRIC_CUTOFFS = (1, 3, 5, 10, 20, 100, 1000)
BATCH_ROWS = 128
ANNOTATION_LIMIT = 1000
ANNOTATION_BUFFER = 10
ANNOTATION_MIN_ROWS = 100
SPLIT_SEED = 42

# Training rows per language.
TRAINING_LIMITS = {
    "ara": 64000, "dan": 64000, "deu": 192000, "eng": 256000, "fas": 128000,
    "fra": 192000, "hin": 64000, "ind": 64000, "ita": 192000, "jpn": 192000,
    "kor": 64000, "nld": 192000, "pol": 128000, "por": 128000, "rus": 192000,
    "spa": 192000, "swe": 64000, "tur": 64000, "vie": 64000, "zho": 64000,
}

# Request texts.
SCORING_PROMPT = """Score the following translation from {source_lang} to {target_lang} on a
continuous scale from 0 to 100, where score of zero means "no meaning preserved" and
score of one hundred means "perfect meaning and grammar". Please provide a short,
concise answer.
{source_lang} source: "{source_seg}"
{target_lang} translation: "{target_seg}"
Score: """

TOPIC_PROMPT = """Please classify the following Q&A pair into one of the following topics:
1) Products and Commercial Services
2) Traveling and Hospitality
3) Healthcare Services, Wellness and Lifestyle
4) Entertainment, Recreation and Leisure
5) Employment, Education and Training
6) Banking, Financial Services and Insurance
7) Legal Services, Regulations and Government
8) General Information and Other

Please answer only with the number of the topic.

Q&A pair: ¿Que restaurantes llevan comida domicilio en Los Cabos ### En el App de DiDifood encontraras mas de null restaurantes con entrega a domicilio en Los Cabos
Label: 2

Q&A pair: चौघड़िया का क्या अर्थ है? ### चौघड़िया शब्द दो शब्दों का मेल है - चो, अर्थात् चार, और घड़िया, यानी घड़ी। हिंदू समय के अनुसार, प्रत्येक घड़ी, 24 मिनट के बराबर है। सूर्योदय से सूर्यास्त तक 30 घड़ी होती हैं जिन्हें 8 से विभाजित किया गया है। इसलिए, दिन में 8 चौघड़िया मुहूर्त और 8 रात्रि चौघड़िया मुहूर्त होते हैं। एक चौघड़िया 4 घड़ी (लगभग 96 मिनट) के बराबर होता है। अतः, एक चौघड़िया लगभग 1.5 घंटे तक रहता है।
Label: 8

Q&A pair: Is DOT coin close to its All Time High price? ### DOT all time high price (ath) is €47.6. Its current price is €6.4. This means that the difference between Polkadot (DOT) All Time High price and DOT current price is -87%.
Label: 6

Q&A pair: Quel est le poids maximum pour un colis? ### Le poids maximum autorisé pour un colis Colissimo ou Chronopost est de 30 kg.
Label: 1

Q&A pair: {question} ### {answer}
Label: """

QUESTION_TYPE_PROMPT = """Please classify the following questions based on their question word type:
1) What - Asking for information about something
2) When - Asking about time
3) Where - Asking in or at what place or position
4) Which - Asking about choice
5) Who/Whom/Whose - Asking what or which person
6) Why - Asking for reason
7) How - Asking about manner, extent or degree
8) Is, are, do, does - Questions expecting a yes or no answer
9) Can, could, will, would, may, might, shall, should - Questions expecting a yes or no answer
10) No Question Word - The provided sentence is not formed as a question

Please answer only with the number of the question word type.

Question: Soğucak Yaylası Nerededir?
Label: 3

Question: شرایط مالیات در سوئد چگونه است؟
Label: 1

Question: Can We Choose our Hotels?
Label: 9

Question: Kā atstāt atsauksmi
Label: 7

Question: {question}
Label: """

QUERY_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"

# ISO 639-1 codes with their ISO 639-3 codes (public standard).
ISO_639_1_TO_3 = dict(
    pair.split(":")
    for pair in """
    aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze
    ba:bak be:bel bg:bul bi:bis bm:bam bn:ben bo:bod br:bre bs:bos
    ca:cat ce:che ch:cha co:cos cr:cre cs:ces cu:chu cv:chv cy:cym
    da:dan de:deu dv:div dz:dzo ee:ewe el:ell en:eng eo:epo es:spa et:est eu:eus
    fa:fas ff:ful fi:fin fj:fij fo:fao fr:fra fy:fry ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv
    ha:hau he:heb hi:hin ho:hmo hr:hrv ht:hat hu:hun hy:hye hz:her
    ia:ina id:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl it:ita iu:iku
    ja:jpn jv:jav ka:kat kg:kon ki:kik kj:kua kk:kaz kl:kal km:khm kn:kan ko:kor kr:kau
    ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz lg:lug li:lim ln:lin lo:lao lt:lit
    lu:lub lv:lav mg:mlg mh:mah mi:mri mk:mkd ml:mal mn:mon mr:mar ms:msa mt:mlt my:mya
    na:nau nb:nob nd:nde ne:nep ng:ndo nl:nld nn:nno no:nor nr:nbl nv:nav ny:nya
    oc:oci oj:oji om:orm or:ori os:oss pa:pan pi:pli pl:pol ps:pus pt:por
    qu:que rm:roh rn:run ro:ron ru:rus rw:kin sa:san sc:srd sd:snd se:sme sg:sag sh:hbs
    si:sin sk:slk sl:slv sm:smo sn:sna so:som sq:sqi sr:srp ss:ssw st:sot su:sun sv:swe sw:swa
    ta:tam te:tel tg:tgk th:tha ti:tir tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi
    ty:tah ug:uig uk:ukr ur:urd uz:uzb ve:ven vi:vie vo:vol wa:wln wo:wol
    xh:xho yi:yid yo:yor za:zha zh:zho zu:zul
    """.split()
)

# Single code points and ranges of the public Unicode property
# Emoji, without digits, "#" and "*".
EMOJI_RANGES = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA
24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623
2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B
267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5
26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F
2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764
2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299
1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F
1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587
1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3
1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7
1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""
