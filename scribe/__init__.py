"""PySpark-native engine for transcription corpora and the evaluation of the systems that read them."""
