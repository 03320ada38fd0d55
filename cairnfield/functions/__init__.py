"""Column functions: documents, texts, dates and geometry. All of them stay in the JVM, but for hulls.py."""
