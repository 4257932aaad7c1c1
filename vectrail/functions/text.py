"""Sentences with {slots}: entities, word bags, deterministic slot filling, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrail.functions.labels import strip_all

SLOT = r"\{([^}]+)\}"

#: Slot names in several languages -> canonical name. Fixed values.
PLACEHOLDERS = {
    "person": "name", "persona": "name", "nome": "name", "nombre": "name", "navn": "name", "artist_name": "artist_name", "name": "name",
    "locatie": "location", "ort": "location", "location": "location", "country": "country", "datum": "date", "date": "date",
    "album_name": "album_name", "track_name": "track_name", "playlist_name": "playlist_name", "movie": "movie", "music_genre": "genre",
    "genre": "genre", "theme": "theme", "faces": "number", "number": "number", "lower": "lower", "upper": "upper", "offset": "offset",
    "satz": "sentence", "sætning": "sentence", "sentence": "sentence", "forespørgsel": "query", "query": "query",
}
#: Fixed values.
GENRES = ("rock", "pop", "jazz", "hip hop", "classical", "electronic", "country", "metal", "blues", "indie")
#: Prefixes that an asymmetric encoder expects. Fixed values.
DOCUMENT_PREFIX, QUERY_PREFIX = "title: none | text: ", "task: search result | query: "

#: Vocabulary of made-up values by locale; other locales use en_US.
VOCABULARY = {
    "en_US": {
        "first": ("Ada", "Ben", "Cora", "Dan", "Eve", "Finn", "Gail", "Hugh"),
        "last": ("Marsh", "Stone", "Field", "Brook", "Hill", "Reed", "Lane"),
        "location": ("Ashford", "Brighton", "Dover", "Elmwood", "Fairview"),
        "country": ("Canada", "Ireland", "Kenya", "Norway", "Peru"),
        "word": ("river", "stone", "cloud", "garden", "window", "music", "paper", "light", "bridge"),
        "phrase": ("Open Road", "Silver Morning", "Quiet Harbor", "Last Train", "Green Valley"),
    },
    "de_DE": {
        "first": ("Anna", "Emil", "Greta", "Jonas", "Lena", "Paul"),
        "last": ("Berg", "Fischer", "Keller", "Lang", "Vogel"),
        "location": ("Bremen", "Kassel", "Mainz", "Ulm", "Weimar"),
        "country": ("Island", "Kenia", "Norwegen", "Polen", "Spanien"),
        "word": ("Fluss", "Stein", "Wolke", "Garten", "Fenster", "Musik", "Papier"),
        "phrase": ("Langer Weg", "Stiller Hafen", "Blauer Morgen"),
    },
}
FILE_TYPES = {"recording": ("wav", "mp3", "ogg", "aac"), "dictation": ("txt", "doc", "docx", "pdf")}


def slot_names(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(SLOT), F.lit(1))


def canonical_slot(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    key = F.lower(strip_all(name))
    return F.coalesce(F.try_element_at(known, key), key)


def entities(sentence: Column) -> Column:
    """Canonical names of all slots, in order."""
    return F.transform(slot_names(sentence), canonical_slot)


def entity(sentence: Column) -> Column:
    """The same, joined by commas; null without slots."""
    found = entities(sentence)
    return F.when(F.size(found) > 0, F.array_join(found, ","))


def strip_slots(sentence: Column) -> Column:
    return strip_all(F.regexp_replace(sentence, r"\{[^}]+\}", ""))


def word_bag(sentence: Column) -> Column:
    """Sorted distinct words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(sentence, r"\s+"), lambda w: w != "")))


def cleaned_lines(text: Column, needed: int) -> Column:
    """The first ``needed`` lines that aren't blank, without list marks."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip_all), lambda x: x != "")
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\d\-\.\*]+\s*", "")), 1, needed)


def draw(seed: Column, n: int) -> Column:
    """A number below ``n`` from the md5 of ``seed``."""
    return (F.conv(F.substring(F.md5(seed), 1, 7), 16, 10).cast("long") % n).cast("int")


def pick(values: tuple[str, ...], seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), draw(seed, len(values)) + 1)


def _value(slot: Column, label: Column, locale: str, seed: Column) -> Column:
    v = VOCABULARY[locale]
    s = lambda tag: F.concat(seed, F.lit("|" + tag))
    person = F.concat_ws(" ", pick(v["first"], s("first")), pick(v["last"], s("last")))
    for kind in ("dictation", "recording"):
        file = F.concat_ws(".", pick(v["word"], s("file")), pick(FILE_TYPES[kind], s("ext")))
        person = F.when(F.contains(F.lower(label), F.lit(kind)), file).otherwise(person)
    words = lambda n: F.concat_ws(" ", *[pick(v["word"], s(f"w{k}")) for k in range(n)])
    ranges = {"number": (1, 100), "lower": (1, 49), "upper": (50, 100), "offset": (1, 12)}
    out = pick(v["word"], s("word"))
    for name, (low, high) in ranges.items():
        out = F.when(slot == name, (draw(s("n"), high - low + 1) + low).cast("string")).otherwise(out)
    out = F.when(slot == "date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), draw(s("day"), 366)), "yyyy-MM-dd")).otherwise(out)
    out = F.when(slot == "genre", pick(GENRES, s("genre"))).otherwise(out)
    out = F.when(slot == "sentence", F.concat(words(6), F.lit("."))).otherwise(out)
    out = F.when(slot == "query", words(4)).otherwise(out)
    for name in ("location", "country"):
        out = F.when(slot == name, pick(v[name], s(name))).otherwise(out)
    out = F.when(slot.isin("album_name", "track_name", "playlist_name", "movie"), pick(v["phrase"], s("phrase"))).otherwise(out)
    return F.when(slot.isin("name", "artist_name"), person).otherwise(out)


def locale_of(lang: Column) -> Column:
    """The locale whose vocabulary a language uses."""
    code = F.replace(F.coalesce(lang, F.lit("")), F.lit("-"), F.lit("_"))
    found = F.lit("en_US")
    for locale in VOCABULARY:
        found = F.when((code == locale) | (code == locale.split("_")[0]), locale).otherwise(found)
    return found


def fill_slots(sentence: Column, label: Column, lang: Column, seed: Column) -> Column:
    """The sentence with every slot replaced by a value drawn from ``seed`` and the slot's place:
    the same on every run, partitioning and retry."""
    pieces = F.split(sentence, r"\{[^}]+\}")
    slots = entities(sentence)

    def value(slot: Column, k: Column) -> Column:
        own = F.concat(seed, F.lit("|"), k.cast("string"))
        out = _value(slot, label, "en_US", own)
        for locale in VOCABULARY:
            if locale != "en_US":
                out = F.when(locale_of(lang) == locale, _value(slot, label, locale, own)).otherwise(out)
        return out

    values = F.concat(F.transform(slots, value), F.array(F.lit("")))
    return F.when(F.size(slots) == 0, sentence).otherwise(
        F.array_join(F.flatten(F.zip_with(pieces, values, lambda p, v: F.array(p, v))), "")
    )
