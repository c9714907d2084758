"""Column functions: text cleaning, scoring of transcriptions, geometry of lines and boxes."""
