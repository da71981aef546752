"""Personal data that is no API key: names, addresses, grouped numbers, short passwords, birth dates."""

from wardflow.llm import private_data

FOUND = [("pay to IBAN: DE89 3704 0044 0532 0130 00 today", "number", "DE89 3704 0044 0532 0130 00"),
         ("phone: (020) 7946 0958.", "number", "(020) 7946 0958"),
         ("password: hunter2 and more", "secret", "hunter2"),
         ("we met Dr. Alice Miller there", "name", "Alice Miller"),
         ("a note by Peter Brown on it", "name", "Peter Brown"),
         ("her address: 12 Baker Street, London", "address", "12 Baker Street"),
         ("er wohnt in Lindenstraße 14, 10115 Berlin", "address", "Lindenstraße 14"),
         ("he was born on 12 March 1980 at sea", "date", "12 March 1980")]
PLAIN = ["years 2019 2020 2021 on page 12 34 56", "the secret garden is the secret door", "Dear Sir and dear Reader",
         "we walked the avenue de Gaulle", "born again and again"]


def test_each_kind_is_found_and_plain_text_is_not(spark):
    texts = [t for t, _, _ in FOUND] * 5 + PLAIN * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.s:s.e]) for s in r.spans]
           for r in private_data.find_private(docs).collect()}
    for i, text in enumerate(texts):
        want = [(k, v) for t, k, v in FOUND if t == text]
        assert got[i] == want, text
