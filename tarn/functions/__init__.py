"""Part of tarn; see the README for what lives here."""
