"""Word lists and patterns. First names are a parameter; the rest are fixed values."""

from __future__ import annotations

#: Default first names: common ones of the German-speaking countries. Pass your own (``first_names=``) for a longer list.
FIRST_NAMES = (
    "Alina Andreas Angela Anja Anna Anne Annika Anton Astrid Barbara Bastian Beate Ben Benjamin Bernd Bernhard Bettina "
    "Birgit Björn Carla Carsten Charlotte Christian Christiane Christina Christine Christoph Clara Claudia Daniel Daniela "
    "David Dennis Dieter Dietmar Dirk Doris Elena Elisabeth Elke Emil Emilia Emma Erik Erika Eva Fabian Felix Finn "
    "Florian Frank Franz Franziska Friedrich Gabriele Georg Gerhard Gisela Greta Günter Hanna Hannah Hans Heike Heinz "
    "Helga Helmut Henrik Herbert Holger Ida Ingrid Jakob Jan Jana Jens Joachim Johanna Johannes Jonas Josef Julia Julian "
    "Jürgen Karin Karl Katharina Katja Katrin Kerstin Klaus Konrad Lara Laura Lea Lena Leon Leonie Lina Linus Lisa Lothar "
    "Louis Luca Luisa Lukas Manfred Manuel Marcel Maria Marie Marion Markus Martin Martina Matthias Max Maximilian Melanie "
    "Mia Michael Michaela Monika Moritz Nadine Nico Nicole Niklas Nina Norbert Oliver Oskar Patrick Paul Paula Peter Petra "
    "Philipp Ralf Regina Renate Robert Rolf Rüdiger Sabine Sandra Sarah Sebastian Silke Simon Sofia Sonja Sophie Stefan "
    "Stefanie Susanne Sven Tanja Theo Thomas Tim Tobias Tom Torsten Ulrich Ursula Ute Uwe Volker Walter Werner Wolfgang"
).split()

# First names that only titles or phrases make a person.
NAME_EXCLUSIONS = ["August", "Mark", "Alexander", "Rose", "Wolf", "Stein", "Berg"]

# Particles inside names.
PARTICLES = ["van", "von", "de", "der", "den", "zum", "zur"]

# Places.
PLACES = [
    "Sweden", "Switzerland", "Austria", "Germany", "France", "Netherlands", "Belgium", "Denmark", "Norway", "Finland",
    "Poland", "Czech Republic", "United Kingdom", "United States", "Canada", "Australia", "Japan", "China", "Schweden",
    "Schweiz", "Österreich", "Deutschland", "Frankreich", "Niederlande", "Dänemark", "Norwegen", "Finnland", "Halmstad",
    "Gothenburg", "Göteborg", "Malmö", "Uppsala", "Zurich", "Zürich", "Bern", "Basel", "Geneva", "Genf", "Antwerp",
    "Antwerpen", "Ghent", "Gent", "Eindhoven", "Utrecht", "Rotterdam", "Gdansk", "Krakow", "Kraków", "Wroclaw",
    "Bratislava", "Ljubljana", "Zagreb", "Tallinn", "Riga", "Vilnius", "Reykjavik",
]

# Brands, in the order in which they are tried.
BRANDS = [
    "Apple", "Samsung", "Google", "Microsoft", "SAP", "Siemens", "Bosch", "ABB", "Phoenix Contact", "HMS", "Anybus", "BMW",
    "Mercedes", "Mercedes-Benz", "Volkswagen", "Audi", "Porsche", "Tesla", "Aspirin", "Ibuprofen", "Ratiopharm",
    "Sparkasse", "Deutsche Bank", "Allianz", "Amazon", "Zalando", "REWE", "EDEKA", "Lidl", "Aldi", "Netto", "PayPal",
    "Visa", "Mastercard", "Intel", "AMD", "NVIDIA", "Oracle", "Cisco", "Huawei", "Sony", "Panasonic", "LG", "Dell", "HP",
    "Lenovo", "Canon", "Epson", "Festo", "Pilz", "Schneider Electric", "Rockwell", "Allen-Bradley",
]

# Capitalised words that rule out a person.
PERSON_STOPWORDS = (
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Montag Dienstag Mittwoch "
    "Donnerstag Freitag Samstag Sonntag Deutschland Europa Amerika Asien Afrika Seite Kapitel Abschnitt Anhang Tabelle "
    "Abbildung Der Die Das Ein Eine Einen Sehr Viele Alle Keine Seine Ihre IT PC OK PDF API XML URL ID ERP CRM HR PR QA "
    "UI UX DB IO OS AI ML"
).split()

# Capitals that are no entity.
ABBREVIATION_STOPWORDS = (
    "IT PC OK PDF API XML URL ID ERP CRM HR PR QA UI UX DB IO OS AI ML DE EN FR US EU UN NATO WHO USD EUR GBP CHF AM PM "
    "CA VS PS NB"
).split()

# Words cut from the end of a listed person: calendar and office words, then roles and departments.
TAIL_WORDS = (
    "Onboarding Day Week Direct Indirect Meeting Call Session Review Sprint Training Workshop Project Team Lead Manager "
    "Director Directors Direktor Direktorin Standup Kickoff Planning Board Interview Office Home Remote Onsite Sync "
    "Townhall Allhands Conference Summit Forum Webinar Seminar Course Class Shift Rotation Buddy Mentor Coach Owner "
    "Stakeholder Update Newsletter Digest Report Deck Slides Notes Agenda Minutes Followup Follow-up Checkin Checkout "
    "Signup Launch Release Beta Alpha Pilot Phase Stage Gate"
).split()
ROLE_WORDS = (
    "Unterstützung Director Directors Direktor Direktorin Direktion Support Marketing Sales Service Services Assistance "
    "Begleitung Beratung Koordination Organisation Kommunikation Entwicklung Vertrieb Einkauf Personal Admin Administrator "
    "Administratorin Consulting Partner Partnerschaft Management Operations Engineering Product Products Solutions "
    "Helpdesk Help Desk Hotline Backoffice Frontend Backend Office Team Group Unit Department Abteilung Bereich Gruppe "
    "Projekt Programm Initiative Workstream Stream Owner Lead Head Chief Officer Representative Specialist Coordinator "
    "Assistant Assistent Assistentin Sachbearbeitung Disposition Logistik Qualität Qualitätssicherung Controlling Finance "
    "Accounting Buchhaltung Recht Legal Compliance Security IT HR PR UX UI"
).split()

# Titles that don't count for a person's identity.
TITLES = ["herr", "frau", "herrn", "dr", "prof", "ing", "mag", "mr", "mrs", "ms", "hr", "fr", "med"]

# Product codes that are paper sizes.
NO_PRODUCT_CODES = [f"{letter}{n}" for letter in "AB" for n in range(7)]

# Cues before a phone number, and before a date of birth.
PHONE_CUES = ["tel.", "telefon", " fon", "mobil", "handy", "fax", "rufnummer", "erreichbar unter", " ruf ", "tel "]
BIRTH_CUES = r"geboren |geb\.|geburtsdatum|geburtstag|date of birth| dob|dob |^dob"
#: One of these stands in every text that has a cue of birth, in lower case.
BIRTH_PARTS = ["geb", "birth", "dob"]

# Month names by number.
MONTHS = [
    ("january", "januar"), ("february", "februar"), ("march", "märz"), ("april",), ("may", "mai"), ("june", "juni"),
    ("july", "juli"), ("august",), ("september",), ("october", "oktober"), ("november",), ("december", "dezember"),
]

# Category, label, priority where spans overlap.
CATEGORIES = [
    ("email", "Email", 9), ("iban", "IBAN", 9), ("telefon", "Phone", 8), ("datum", "Date", 7), ("person", "Person", 4),
    ("firma", "Company", 5), ("produkt", "Product", 3), ("ort", "Location", 3), ("betrag", "Amount", 6),
    ("sonstiges", "Other", 2),
]
LABELS = {c: label for c, label, _ in CATEGORIES}
PRIORITIES = {c: p for c, _, p in CATEGORIES}

# Sources of a detection, the stronger the higher.
SOURCE_RANKS = {"rule": 1, "hybrid": 2, "lexicon": 3, "parser": 4, "ner": 5}
