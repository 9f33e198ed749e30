"""Words, patterns and tables that must be what they are for the same listings to be read in the same way.

Patterns are for rlike() and regexp_extract(); (?iu) is put before them where they are used.
"""

from __future__ import annotations

#: Item-specific and descriptor labels, as keys, for each concept.
LABELS = {
    "game": ["spiel", "game", "gioco", "jeu", "spel", "gra", "juego", "franchise"],
    "card_name": ["kartenname", "card_name", "nome_della_carta", "nome_carta", "nom_de_la_carte", "kaartnaam", "nazwa_karty", "nombre_de_la_carta", "japanischer_kartenname", "kartenname_jp"],
    "character": ["charakter", "character", "personaggio", "personnage", "personage", "postac", "personaje"],
    "number": ["kartennummer", "card_number", "numero_della_carta", "numero_carta", "numero_de_carte", "kaartnummer", "numero_de_carta", "nummer"],
    "set": ["set", "satz", "zestaw", "coleccion", "japanische_expansion", "japanischer_erweiterungsname", "japanische_erweiterung", "erweiterungsmarkierung", "expansionmark", "edition_jp"],
    "language": ["sprache", "language", "lingua", "langue", "taal", "idioma", "jezyk"],
    "rarity": ["seltenheit", "rarity", "rarita", "rarete", "zeldzaamheid", "rzadkosc", "raritat", "japanische_raritat"],
    "finish": ["oberflache", "finish", "finitura", "finition", "afwerking", "acabado", "oberflacheneffekt", "holo_foil", "holo", "veredeltes"],
    "features": ["eigenschaften", "features", "caratteristiche", "caracteristiques", "kenmerken", "merkmale", "besonderheiten", "cechy", "caracteristicas", "parallel_variety", "parallel_variante", "parallel_vielfalt", "variety", "sortenstammbaum"],
    "year": ["baujahr", "herstellungsjahr", "year_manufactured", "anno_di_fabbricazione", "anno_di_produzione", "annee_de_fabrication", "productiejaar", "rok_produkcji", "ano_de_fabricacion", "jahr", "jahrgang", "erscheinungsjahr", "issue_year", "publish_year", "produktionsjahr", "jahr_hergestellt", "year"],
    "hp": ["hp", "kp", "punti_vita_pv", "points_de_vie_pv"],
    "illustrator": ["zeichner", "illustrator", "illustratore", "dessinateur", "ilustrador_o_dibujante"],
    "stage": ["buhne", "stage", "entwicklungsstufe", "fase", "stade_d_evolution", "palcoscenico"],
    "card_type": ["kartentyp", "card_type", "tipo_di_carta", "type_de_la_carte", "type_de_carte", "soort_kaart", "type_kaart", "rodzaj_karty", "tipo_de_carta", "art_der_karte"],
    "speciality": ["spezialitat", "speciality", "specialty", "specialita", "specialite", "especialidad", "specialiteit", "specjalnosc", "spezialkarte"],
    "convention": ["convention_event", "tagung_veranstaltung", "tagung_oder_veranstaltung", "convention_evento", "evenement", "event_tournament", "convention_ou_evenement"],
    "edition": ["edition", "edizione", "editionen"],
    "grader": ["professional_grader", "bewertungsexperte", "professioneller_grader", "profi_grader", "grader", "grading_company", "expertenbewertung", "grado_profesional", "tasador_profesional", "professionele_grader", "professionele_taxateur", "classificateur_professionnel", "certificateur_professionnel", "societe_de_gradation_professionnelle", "organisme_de_certification", "societe_de_notation", "gradation_professionnelle", "professionelle_abstufung", "valutatore_professionista", "segnapunti_professionale", "livellatrice_professionale", "profesjonalny_rzeczoznawca"],
    "grade": ["grade", "bewertung", "grado", "note", "nota", "classificazione", "classification", "clasificacion", "ocena", "sterkte", "grad"],
    "cert": ["certification_number", "zertifizierungsnummer", "zertifikationsnummer", "zertifizierung", "psa_nummer", "numero_de_certificacion", "numero_de_certification", "numero_di_certificazione", "certificeringsnummer", "numer_certyfikatu"],
    "count": ["anzahl_karten", "anzahl_karten_im_lot", "kartenanzahl", "karten_zahlen", "number_of_cards", "numero_di_carte", "nombre_de_cartes", "numero_de_cartas", "cards_count", "aantal_kaarten", "menge", "hoeveelheid", "quantita"],
}

#: Keys that mean not applicable.
NOT_APPLICABLE = ["na", "n_a", "nein", "no", "none", "nicht_zutreffend", "non_applicabile", "sonstige", "other", "andere", ""]

#: Words for a language; the first match wins.
LANGUAGES = [
    ("japan|giappone|japon|jp\\b|jpn", "ja"),
    ("deutsch|german|tedesc|allemand|duits", "de"),
    ("english|englisch|inglese|anglais|engels|\\beng\\b", "en"),
    ("franzos|french|francese|francais|frans", "fr"),
    ("italien|italian|italiano|italiaans", "it"),
    ("spanisch|spanish|spagnol|espanol|espagnol", "es"),
    ("korean|koreanisch|coreano", "ko"),
    ("chines|cinese|chinois", "zh"),
    ("portug", "pt"),
]
CATALOGUE_LANGUAGES = ["en", "de", "ja"]
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff]"

#: The game in scope, other games, lots and products that are no cards.
FRANCHISE = "pok[eé]mon|pokemon|pok[eé]ka|pocket monsters"
OTHER_GAMES = "dragon ?ball|\\bdb[sz]\\b|fusion world|one ?piece|yu-?gi-?oh|magic the gathering|\\bmtg\\b|digimon|weiss schwarz|lorcana|cardfight|vanguard|metazoo|flesh and blood|gundam|garbage pail|panini|donruss|fleer|bowman|upper deck|prizm|rated rookie|invincible|\\bnba\\b|\\bnfl\\b"
LOTS = "\\b(lot of|lot de|bundle|joblot|job lot|sammellos|konvolut|lote de|playset|sammlung|collection of|set of \\d|\\d+er set|\\dx |x ?\\d+ karten|karten ?set)\\b"
OTHER_PRODUCTS = "\\b(sealdass|hanafuda|old maid|babanuki|playing cards?|spielkarten|taruka|phone ?card|telefonkarte|sticker|aufkleber|münze|figur|pin badge|puzzle|poster|topps)\\b"

#: Wording of finishes, print runs, small variants and stamps.
HINTS = {
    "finish": [("reverse ?holo|reverse ?foil|reverse", "reverse"), ("\\bholo(gra\\w*|foil)?\\b|glitzer", "holo"), ("non[- ]?holo|regular|normal", "normal")],
    "print_run": [("1st ?ed|first ?ed|1\\.? ?auflage|erstauflage|edicion 1|edizione 1", "first_edition"), ("shadowless|schattenlos", "shadowless"), ("unlimited|unbegrenzt", "unlimited")],
    "micro": [
        ("full ?art|\\bfa\\b", "full_art"), ("secret ?rare|\\bsr\\b", "secret"), ("rainbow", "rainbow"), ("illustration ?rare|\\bar\\b", "illustration_rare"),
        ("special ?illustration|\\bsar\\b", "special_illustration_rare"), ("master ?ball", "master_ball_reverse_holo"), ("pok[eé] ?ball", "poke_ball_reverse_holo"),
    ],
    "stamp": [("\\bstaff\\b", "staff"), ("pre ?release|vorver", "pre_release"), ("pok[eé]mon ?cent(er|re)", "pokemon_center"), ("set ?logo|stamped|gestempelt", "set_logo"), ("25th|celebrat", "25th_celebration")],
}

#: Condition of graded cards, graders in titles, the one grader in scope.
GRADED_CONDITION = "2750"
TITLE_GRADE = "\\b(PSA|BGS|CGC|SGC)\\s*[- ]?\\s*(10|9\\.5|9|8\\.5|8)\\b"
GRADER = "(^|[^a-z0-9])psa([^a-z0-9]|$)"

#: Words beside a fraction that make it a grade, denominators that are no set, prefixes that are no card number.
GRADING_WORDS = ["psa", "bgs", "cgc", "sgc", "ace", "tag"]
NO_SET = ["psa", "bgs", "cgc", "sgc", "no", "auto", "ovp", "gem", "mint", "nm", "mt", "eur", "usd", "gbp"]
NO_PREFIX = ["psa", "bgs", "cgc", "sgc", "gem", "mt", "nm", "lp", "ovp", "eur", "usd", "gbp", "ver", "no", "nr", "x", "lot", "pcs", "stk", "st"]
#: Trust in a reading by its source and by its form.
SOURCE_WEIGHTS = {"aspect": 1.0, "title": 0.85, "description": 0.45}
FORM_WEIGHTS = {"bare": 1.0, "fraction": 0.95, "hash": 0.8, "alnum": 0.55, "loose": 0.5}

#: Words that name no set in report headings, languages in them, and the code in front of a set's name.
HEADING_STOP = ["pokemon", "pokémon", "promo", "promos", "tcg", "card", "cards", "the", "of", "set", "amp"]
HEADING_LANGUAGES = [("french", "fr"), ("german", "de"), ("italian", "it"), ("spanish", "es"), ("japanese", "ja"), ("korean", "ko"), ("portuguese", "pt"), ("chinese", "zh")]
HEADING_CODE = "^pokemon\\s+(?:japanese|german|french|italian|spanish|korean|portuguese|chinese)\\s+([A-Za-z0-9.-]{1,8})\\s*-\\s*\\S"
#: Languages in a report row's variety, and the endings of its subject that are no part of the name.
VARIETY_LANGUAGES = {"english": "en", "german": "de", "japanese": "ja", "french": "fr", "italian": "it", "spanish": "es", "korean": "ko", "portuguese": "pt", "chinese": "zh"}
OTHER_VARIETY = "-(french|german|italian|spanish|japanese|korean|portuguese|chinese)\\b"
SUBJECT_ENDINGS = "-\\s*(Holo|Reverse Foil|1st Edition|Shadowless|Unlimited|Staff|Prerelease)\\b"

#: Forms in which a certificate page names its spec, tried in order.
SPEC_PATTERNS = ["(?i)\"specId\"\\s*:\\s*\"?(\\d{4,})\"?", "\"SpecID\"\\s*:\\s*\"?(\\d{4,})\"?", "(?i)/spec/psa/(\\d{4,})", "(?i)/pop/[^\"']*/card/(\\d{4,})", "(?i)/cardfacts/[^\"']*/card/(\\d{4,})"]

#: Labels that are not their key's parts with a capital letter.
KNOWN_LABELS = {
    "holo": "Holo", "normal": "Normal", "reverse": "Reverse", "unlimited": "Unlimited", "first_edition": "1st Edition", "shadowless": "Shadowless",
    "shadowless_first_edition": "Shadowless · 1st Edition", "standard": "Standard", "jumbo": "Jumbo", "1999_2000_copyright": "1999–2000 copyright",
}

#: Attributes of a card that are kept.
KEPT_ATTRIBUTES = ["illustrator", "hp", "types", "stage", "evolveFrom", "description", "retreat", "regulationMark", "dexId", "legal"]

#: Upper ends of the price bands of an open search; the last band is open.
PRICE_BANDS = [25, 50, 100, 250, 500, 1000, 2500, 5000]
