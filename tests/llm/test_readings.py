"""Decontamination: names that begin a text or a sentence."""

from conftest import rows

from tessera.llm import decontaminate

ITEM = "Alice has 12 red apples in a basket. Bob gives her 5 more apples before lunch. How many red apples does Alice have now?"


def changed(*values):
    first, a, second, b, last = values
    return f"{first} has {a} red apples in a basket. {second} gives her {b} more apples before lunch. How many red apples does {last} have now?"


def test_names_at_sentence_starts(spark):
    docs = [
        (1, changed("Maria", 31, "Peter", 8, "Maria")), (2, f"Some words.\n\"{changed('Maria', 31, 'Peter', 8, 'Maria')}\""), (3, changed("Maria", 31, "Peter", 8, "Peter")), (4, ITEM),
        (5, "Alice gives a lecture. How many came? Bob did not."), (6, ITEM.replace("How", "Now how")), (7, ITEM.replace("Alice has", "alice has")),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, ITEM)], "item_id long, text string"))
    assert rows(found, "doc_id", "reparameterised") == [(1, True), (2, True), (4, False), (6, False), (7, False)]


def test_items_of_placeholders_alone(spark):
    docs = [(1, "Read: 9 8 7 6 5 4 3, and stop."), (2, "1 2 3 4 5 6 7"), (3, "9 8 7 6 5 4 2 and 9 8 7"), (4, None), (5, "42"), (6, "42 43")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, "9 8 7 6 5 4 3"), (8, "42"), (7, ""), (6, None)], "item_id long, text string"))
    assert rows(found, "doc_id", "item_id", "windows", "of", "reparameterised") == [(1, 9, 3, 3, False), (5, 8, 1, 1, False)]


#: Questions with slots {n0}, {n1} (names), {0}, {1}, ... (numbers) and {u} (a unit).
QUESTIONS = [
    "{n0} picks {0} pears on Monday and {1} pears on Friday. If {n0} gives {2} of them to {n1}, how many pears are left in the basket?",
    "A train covers {0} {u} before noon and {1} {u} after noon. How many {u} does it cover on the whole journey that day?",
    "In a school choir there are {0} singers in the first row and {1} singers in the second row. {n0} counts them all. What number does {n0} get?",
    "{n0} buys {0} notebooks at {1} coins each and pays with {2} coins. How much change does the shop give back to {n0}?",
    "The tank of the old tractor holds {0} {u} of fuel. After a day in the field {1} {u} are gone. How much fuel is still in the tank at night?",
    "{n0} reads {0} pages every evening while {n1} reads {1} pages every morning. After {2} days, who has read more pages and by how many?",
    "A baker makes {0} loaves every hour. He works for {1} hours and sells all but {2} loaves. How many loaves did the baker sell today?",
    "{n0} and {n1} share a rope of {0} {u}. {n0} cuts off a piece of {1} {u} for the tent. How long is the part that remains for {n1}?",
    "Each box on the shelf weighs {0} {u} and the shelf can carry {1} {u}. How many boxes may stand on the shelf at the same time?",
    "Yesterday {n0} ran around the lake {0} times, which took {1} minutes. How many minutes did one round take on average for {n0}?",
    "There were {0} birds on the wire. Then {1} birds flew away and {2} others came back. How many birds are now sitting on the wire?",
    "{n0} has a garden with {0} rows of carrots and {1} carrots in each row. Rabbits ate {2} of the carrots. How many carrots can {n0} still pull?",
]


def variant(question, i):
    names = ["Maria", "Peter", "Olga", "Jean", "Ahmed", "Yuki", "Lena", "Tom"]
    return question.format(*[11 + 7 * i + 13 * k for k in range(3)], n0=names[i % 8], n1=names[(i + 3) % 8], u=["km", "miles", "meters", "liters", "kg"][i % 5])


def test_recall_of_reparameterised_questions(spark):
    """Every question with other numbers, names and units, alone and within other text; and questions that mix up their slots."""
    items = [(k, variant(q, 0)) for k, q in enumerate(QUESTIONS)]
    docs, wanted, wrong = [], set(), []
    for k, q in enumerate(QUESTIONS):
        for i in range(1, 6):
            at = 100 * k + i
            docs.append((at, variant(q, i) if i % 2 else f"Some exercise from a book. {variant(q, i)} The answer is at the end."))
            wanted.add((at, k))
        wrong.append((10_000 + k, " ".join(reversed(variant(q, 2).split()))))
    docs += [*wrong, (20_000, "Maria picks flowers on Monday and reads a book on Friday, while the train covers the land.")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    pairs = set(rows(found, "doc_id", "item_id"))
    assert len(pairs & wanted) >= 0.9 * len(wanted) and pairs <= wanted
