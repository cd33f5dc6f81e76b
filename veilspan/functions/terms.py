"""Word lists of the validators."""

from __future__ import annotations

# Places that are no personal or organization names.
GEOGRAPHIC_EXCLUSIONS = [
    "Albania", "Andorra", "Austria", "Belarus", "Belgium", "Bosnia", "Bulgaria", "Croatia", "Cyprus", "Czechia", "Denmark", "Estonia", "Finland", "France", "Germany",
    "Greece", "Hungary", "Iceland", "Ireland", "Italy", "Latvia", "Liechtenstein", "Lithuania", "Luxembourg", "Malta", "Moldova", "Monaco", "Montenegro", "Netherlands",
    "Norway", "Poland", "Portugal", "Romania", "Serbia", "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland", "Ukraine", "Vatican", "Gibraltar", "Isle", "Jersey",
    "Guernsey", "United", "Kingdom", "Great", "Britain", "Northern", "Scotland", "Wales", "England", "California", "Texas", "Florida", "York", "Illinois", "United Kingdom",
    "Europe", "Asia", "Africa", "America", "Australia", "Antarctica", "European", "Union", "Baltic", "Scandinavia", "Mediterranean", "Europoje", "Europos", "Sąjungos",
    "Baltijos", "Šiaurės", "Rytų", "Vakarų", "Pietų", "Vidurio", "Respublikos", "Respublika", "Lietuvos", "Latvijos", "Estijos", "Lenkijos", "Rusijos", "Baltarusijos",
    "Ukrainos", "Vilnius", "Kaunas",
]

# Words of documents that are no personal names.
DOCUMENT_TERMS = [
    "Document", "Certificate", "Policy", "Agreement", "Contract", "Report", "Statement", "Invoice", "Receipt", "Form", "Application", "Declaration", "Registration",
    "License", "Permit", "Warranty", "Terms", "Conditions", "Summary", "Details", "Information", "Data", "Record", "File", "Number", "Code", "Reference", "Identification",
    "Identity", "Personal", "Business", "Company", "Organization", "Institution", "Department", "Office", "Agency", "Ministry", "Government", "Authority", "Service",
    "Center", "Unit", "Branch", "Card", "Dokumentas", "Pažymėjimas", "Polisas", "Sutartis", "Ataskaita", "Pareiškimas", "Registracija", "Licencija", "Leidimas", "Garantija",
    "Sąlygos", "Informacija", "Duomenys", "Įrašas", "Failas", "Numeris", "Kodas", "Nuoroda", "Tapatybė", "Asmens", "Verslo", "Įmonės", "Organizacijos", "Institucijos",
    "Skyrius", "Biuras", "Agentūra", "Ministerija", "Valdžia", "Tarnyba", "Centras", "Padalinys", "Filialas", "Privalomojo", "Draudimo", "Civile", "Atsakomybe", "Transporto",
    "Priemone", "When", "Where", "What", "Which", "Who", "Pavadinimas", "Liudijimas", "Arba", "Metų", "Mėnesio", "Statyba", "Statybos", "statyba", "statybos", "Insurance",
    "Insurer", "Insured", "Coverage", "Premium", "Claim", "Liability", "Motor", "Vehicle", "Auto", "Property", "Health", "Life", "Travel", "Standard", "Third", "Party",
    "Comprehensive", "Collision", "Deductible", "Excess", "Draudimas", "Draudėjas", "Draustojas", "Draudžiamasis", "Išmoka", "Žala", "Atsakomybė", "Automobilio", "Turto",
    "Sveikatos", "Gyvybės", "Kelionių", "Standartinis", "Trečiojo", "Visapusiškas", "Išskaita",
]

# Words with the shape of bank codes.
LITHUANIAN_COMMON_WORDS = [
    "PRIVALOMOJO", "DRAUDIMO", "SUTARTIS", "LIETUVOS", "RESPUBLIKA", "BENDROVĖ", "UŽDAROJI", "AKCINĖ", "VIEŠOJI", "MAŽOJI", "INDIVIDUALI", "VEIKLA", "ĮMONĖ", "VALDYBA",
    "DIREKTOR", "ATSTOVAS", "PARTNERIS", "DARBUOTOJAS", "KLIENTAS", "PASLAUGOS", "PRODUKTAS", "SISTEMA", "TECHNOLOG", "ELEKTRONIKA", "KOMPIUTER", "PROGRAMOS", "DUOMENYS",
    "SAUGUMAS", "PRIVATUMAS", "KONFIDENCIAL", "SLAPTAS", "OFICIALUS", "DOKUMENTAS", "PAŽYMĖJIMAS", "SERTIFIKAT", "REGISTRAC", "LICENCIJ", "LEIDIMAS", "TEISĖS", "PAREIGOS",
    "ATSAKOMYB", "GARANTIJA", "SĄLYGOS", "NUOSTAT",
]

# Phrases in capitals that are no names.
COMMON_ALL_CAPS_NON_NAMES = [
    "LENGVASIS AUTOMOBILIS", "KROVININIS AUTOMOBILIS", "TECHNINĖ APŽIŪRA", "GALIOJA IKI", "ASMUO KONTAKTAI", "VARIKLIO GALIA", "SĖDIMŲ VIETŲ", "STOVIMŲ VIETŲ",
    "PRIEKINIAI ŽIBINTAI", "GALINIAI ŽIBINTAI", "DUOMENYS NEIDENTIFIKUOTI", "ŽALIOJI KORTELĖ", "TRANSPORTO PRIEMONĖS REGISTRACIJOS NUMERIS",
    "TECHNINĖS APŽIŪROS REZULTATŲ ATASKAITA", "VALSTYBINIS NUMERIS", "DRAUDIMO POLISAS", "AUTOMOBILIO REGISTRACIJOS NUMERIS", "ARBA AUTOBUSAS", "MOTOCIKLAS DVIRATIS",
    "VARIKLIU PRIEKABA", "KITI AUTOBUSAS", "PRIEKABA DVIRATIS", "VARIKLIU MOTOCIKLAS",
]
