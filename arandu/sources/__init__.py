"""Sources: files of a folder, their parsers, OCR results and stored documents."""
