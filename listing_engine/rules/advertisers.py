"""Advertiser aliases."""

# Advertiser name on one portal -> canonical name.
ADVERTISER_ALIASES = {
    "Remax Concorde": "TEAM CONCORDE",
    "Núcleo Alcoy": "Núcleo Gestiones Inmobiliarias Alcoy",
    "Hipoges": "Hipoges",
    "CLIKALIA": "Clikalia España",
    "Fincas Valencia Consultores Inmobiliarios": "FINCAS VALENCIA CONSULTORES INMOBILIARIOS",
    "Gestores inmobiliarios": "GESTORES INMOBILIARIOS",
    "PERCENT SERVICIOS": "Percent Servicios Inmobiliarios",
    "NEXT HOME INMOBILIARIA": "NEXT HOME INMOBILIARIA",
    "Inmobiliaria Norte": "INMOBILIARIA NORTE",
    "INMOBILIARIA ARACIL": "inmobiliaria aracil",
    "OLCINA INMOBILIARIA": "INMOBILIARIA OLCINA",
    "ABARCA SERVICIOS INMOBILIARIOS S.L.": "Abarca servicios inmobiliarios",
    "Grupo ARAI": "Arai",
    "ROQUETA INVESTMENT": "SA ROQUETA INVESTMENT",
    "Aliseda Inmobiliaria": "Aliseda inmobiliaria",
    "Inmobiliaria Aspelx": "ASPELX GESTIÓN INMOBILIARIA",
    "TXCASAS": "TX CASAS INMOBILIARIA",
    "Solvia Inmobiliaria": "Solvia inmobiliaria",
    "GTI INMOFREELANCE": "GTI INMOFREELANCE",
    "Remax Blue": "Remax Blue",
    "REMAX INMOMAS": "Grupo RE/MAX Inmomás",
    "Gestimar Inmobiliaria": "GESTIMAR INMOBILIARIA",
    "Inmobiliaria Hache": "Inmobiliaria Hache",
    "Next Steps Spain": "NEXT STEP PROPERTIES",
    "REDTOONE INVESTMENTS": "redtoone inmobiliaria",
    "Servicios Inmobiliarios Interworld": "SERVICIOS INMOBILIARIOS INTERWORLD",
    "Invest MSS": "INVEST MSS REAL ESTATE",
    "Buve": "BUVE",
    "Tarrazó Inmobiliaria": "Inmobiiaria Tarrazó",
    "INMOBROKERS": "INMOBROKERS.ES",
    "Te Compro La Casa": "TE COMPRO LA CASA",
    "Altages Inmobiliaria": "ALTAGES INMOBILIARIA",
    "Century 21 Plaza": "Century 21 Plaza",
    "Mocadi Real Estate Calpe": "Mocadi Calpe",
    "Mar de Casas": "Mar de Casas",
    "Gestor De Propiedades Andreas": "GESTOR DE PROPIEDADES ANDREAS",
    "Kapitalia Inmobiliaria": "Kapitalia Inmobiliaria",
    "HogarAbitat": "HOGARABITAT SERVICIOS INMOBILIARIOS",
    "Maravillas International Realty Group": "International Realty",
}
