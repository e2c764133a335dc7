"""Word lists and codes of the address domain. Results depend on them."""

# City and district names that never stand for a street or zone alone.
CITIES = ["CHICLAYO", "LAMBAYEQUE", "FERRENAFE", "FERREÑAFE", "PIMENTEL", "LA VICTORIA", "JOSE LEONARDO ORTIZ", "JOSÉ LEONARDO ORTIZ", "JLO", "J.L.O.", "MONSEFU", "MONSEFÚ"]

# Abbreviations written out while cleaning.
EXPANSIONS = {"MCDO": "MERCADO", "STA": "SANTA", "STO": "SANTO", "TDA": "TIENDA", "STD": "STAND", "PTO": "PUESTO", "EXT": "EXTERIOR", "CDRA": "CUADRA"}

# Words without meaning in the comparison of names.
STREET_STOPWORDS = ["AV", "AVENIDA", "CA", "CALLE", "JR", "JIRON", "PJE", "PASAJE", "PRLG", "PROLONGACION", "CTRA", "CARRETERA", "AL", "ALAMEDA", "PSO", "PASEO", "DE", "DEL", "LA", "LAS", "LOS", "EL"]
ZONE_STOPWORDS = [
    "URB", "URBANIZACION", "PJ", "PUEBLO", "JOVEN", "AH", "ASENTAMIENTO", "HUMANO", "CONJ", "HAB", "RES", "COOP", "ASOC", "VIV", "DE", "DEL", "LA", "LAS", "LOS", "EL",
    "CHICLAYO", "LAMBAYEQUE", "PIMENTEL", "FERRENAFE", "FERREÑAFE", "PERU", "PERÚ",
]

# Types by id.
STREET_TYPES = {
    1: ("AVENIDA", "AV.", ["AVENIDA", "AV", "AV.", "AVDA", "AVDA."]),
    2: ("CALLE", "CA.", ["CALLE", "CA", "CA.", "CL", "CL.", "C."]),
    3: ("JIRON", "JR.", ["JIRON", "JIRÓN", "JR", "JR."]),
    4: ("PASAJE", "PJE.", ["PASAJE", "PJE", "PJE.", "PSJ", "PSJ."]),
    5: ("ALAMEDA", "AL.", ["ALAMEDA", "AL", "AL."]),
    6: ("CARRETERA", "CTRA.", ["CARRETERA", "CTRA", "CTRA.", "CRTA", "CARR"]),
    7: ("PROLONGACION", "PRLG.", ["PROLONGACION", "PROLONGACIÓN", "PRLG", "PRLG.", "PROL"]),
    8: ("PASEO", "PSO.", ["PASEO", "PSO", "PSO."]),
    9: ("MALECON", "ML.", ["MALECON", "MALECÓN", "ML", "ML."]),
    10: ("CAMINO", "CM.", ["CAMINO", "CM", "CM."]),
    11: ("PLAZA", "PZ.", ["PLAZA", "PZ", "PZ."]),
    12: ("PLAZUELA", "PZLA.", ["PLAZUELA", "PZLA", "PZLA."]),
}
COMPONENT_TYPES = {
    1: ("MANZANA", ["MANZANA", "MZ", "MZA", "MZA.", "MZ."]),
    2: ("LOTE", ["LOTE", "LT", "LT."]),
    3: ("SUBLOTE", ["SUBLOTE", "SLOTE", "SLT", "SLT.", "SUB-LOTE", "SUB LOTE"]),
    4: ("PISO", ["PISO", "PISOS", "NIVEL"]),
    5: ("PREDIO", ["PREDIO", "FUNDO"]),
    6: ("VALLE", ["VALLE"]),
    7: ("SECTOR", ["SECTOR"]),
    8: ("UNIDAD CATASTRAL", ["UNIDAD CATASTRAL", "UC", "U.C."]),
    9: ("COORDENADA NORTE", ["COORDENADA NORTE", "NORTE"]),
    10: ("COORDENADA ESTE", ["COORDENADA ESTE", "ESTE"]),
    11: ("BLOCK", ["BLOCK", "BLOQUE", "BLQ", "BLQ.", "TORRE", "TORRE.", "PABELLON", "PABELLÓN", "PAB", "PAB."]),
}
URBAN_COMPONENTS = [1, 2, 3, 4, 11]
UNIT_TYPES = {
    1: ("INTERIOR", ["INTERIOR", "INT", "INT."]),
    2: ("DEPARTAMENTO", ["DEPARTAMENTO", "DPTO", "DPTO.", "DEP", "DEP."]),
    3: ("PUERTA", ["PUERTA", "PTA", "PTA."]),
    4: ("STAND", ["STAND", "STAND.", "STD"]),
    5: ("TIENDA", ["TIENDA", "TDA", "TDA."]),
    6: ("OFICINA", ["OFICINA", "OF", "OF."]),
    8: ("PUESTO", ["PUESTO", "PTO"]),
    9: ("LOCAL", ["LOCAL", "LC"]),
    10: ("COCHERA", ["COCHERA", "ESTACIONAMIENTO"]),
}

# Brands counted by the risk score.
BRANDS = ["BORETO", "CURACAO", "ESTILOS", "FALABELLA", "I-RUN", "METRO", "NOW", "OECHSLE", "PLAZA VEA", "PROMART", "RIPLEY", "SAGA", "SODIMAC", "SUPERPET", "TAI LOY", "TOTTUS"]

# Words of numbers in names, written as digits.
NUMBER_WORDS = {"NUEVE": "9", "OCHO": "8", "SIETE": "7", "SEIS": "6", "TRES": "3", "DOS": "2", "PRIMERO": "1", "VEINTIOCHO": "28", "VEINTISIETE": "27", "QUINCE": "15", "CATORCE": "14", "DOCE": "12"}
STAGES = {1: ("PRIMERA", "I", "RA|ERA"), 2: ("SEGUNDA", "II", "DA|DO"), 3: ("TERCERA", "III", "RA|ERA"), 4: ("CUARTA", "IV", "TA|TO"), 5: ("QUINTA", "V", "TA|TO")}

# Canonical forms used by the validation.
TOKEN_NOISE = ["N", "NO", "N°", "Nº", "NUM", "NUM°", "NUMº", "NRO", "NRO°", "NROº", "NUMERO", "NUMERACION"]
TOKEN_STOPWORDS = ["DE", "DEL", "LA", "EL", "LOS", "LAS", "EN", "A", "AL", "Y", "E", "O", "U", "POR", "CON", "PARA", "SIN", "SOBRE", "ENTRE", "HACIA", "HASTA", "CHICLAYO", "LAMBAYEQUE", "PERU", "PERÚ"]
TOKEN_ORDINALS = {
    "PRIMER": "1", "PRIMERA": "1", "PRIMERO": "1", "UNO": "1", "SEGUNDO": "2", "SEGUNDA": "2", "DOS": "2", "TERCER": "3", "TERCERA": "3", "TERCERO": "3", "TRES": "3",
    "CUARTO": "4", "CUARTA": "4", "CUATRO": "4", "QUINTO": "5", "QUINTA": "5", "CINCO": "5", "SEXTO": "6", "SEXTA": "6", "SEIS": "6", "SEPTIMO": "7", "SEPTIMA": "7", "SIETE": "7",
    "OCTAVO": "8", "OCTAVA": "8", "OCHO": "8", "NOVENO": "9", "NOVENA": "9", "NUEVE": "9", "DECIMO": "10", "DECIMA": "10", "DIEZ": "10", "ONCE": "11", "DOCE": "12", "TRECE": "13",
    "CATORCE": "14", "QUINCE": "15", "VEINTE": "20", "VEINTISIETE": "27", "VEINTIOCHO": "28",
    "I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10",
}
TOKEN_FORMS = {
    "AV": "AVENIDA", "AVDA": "AVENIDA", "CA": "CALLE", "CL": "CALLE", "JR": "JIRON", "JRN": "JIRON", "PSJ": "PASAJE", "PJE": "PASAJE", "PRL": "PROLONGACION", "PROL": "PROLONGACION",
    "MZ": "MANZANA", "MZA": "MANZANA", "LT": "LOTE", "LTE": "LOTE", "SLT": "SUBLOTE", "SL": "SUBLOTE", "DPTO": "DEPARTAMENTO", "DEP": "DEPARTAMENTO", "DTO": "DEPARTAMENTO", "INT": "INTERIOR",
    "URB": "URBANIZACION", "PJ": "PUEBLO JOVEN", "PPJJ": "PUEBLO JOVEN", "AH": "ASENTAMIENTO HUMANO", "AAHH": "ASENTAMIENTO HUMANO", "CP": "CENTRO POBLADO", "SEC": "SECTOR",
    "BLQ": "BLOCK", "BLOQUE": "BLOCK", "TORRE": "BLOCK", "TDA": "TIENDA", "STD": "STAND", "OF": "OFICINA", "PTO": "PUESTO", "PTA": "PUERTA",
    "CONDOMINIO": "URBANIZACION", "RESIDENCIAL": "URBANIZACION", "COOPERATIVA": "URBANIZACION", "ASOCIACION": "URBANIZACION",
}
TOKEN_STREET_TYPES = ["AVENIDA", "CALLE", "JIRON", "PASAJE", "PROLONGACION", "CARRETERA", "AUTOPISTA"]
TOKEN_ZONE_TYPES = ["URBANIZACION", "PUEBLO JOVEN", "ASENTAMIENTO HUMANO", "CENTRO POBLADO", "SECTOR", "CONDOMINIO", "RESIDENCIAL"]
CORNER_WORDS = ["ESQ", "ESQUINA", "CRUCE", "CON", "INTERSECCION"]
